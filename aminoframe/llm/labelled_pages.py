"""Labelled pages: many layouts, drawn from a seed, in which every block says whether it belongs to the main text."""

from __future__ import annotations

import random

#: Words of the pages' texts.
_WORDS = "the a of and to in for with on by from at bridge river council road plan winter school market story people year work house light water field train music garden paper house stone letter city day report team price share form search side menu notice".split()
#: Class names of wrappers and main texts, as sites use them.
_CONTENT = "content main-content article article-body article-content post post-body post-content entry entry-content story story-body text body-text prose page-content main single hentry blog-post news-item copy rich-text section-text chapter".split()
_TITLE = "entry-header post-header article-header page-title entry-title headline title story-header post-title".split()
_PLAIN_WRAPPER = "wrapper container layout page row col grid site inner outer clearfix".split()
_WRAPPER = "wrapper container layout page row col grid site inner outer has-sidebar no-sidebar with-comments two-column clearfix main-wrapper site-main".split()
_AFFIX = "box block wrap area unit list item inner top bottom left right main section banner thread zone js 1 2 300x250".split()
#: Class names inside main texts that hold words which also name boilerplate.
_MIXED = "share-price side-effects search-results form-factor alert-level legal-analysis menu-of-the-day comment-on-law banner-year social-history login-guide related-work header-row notice-period widget-review footer-note promo-history nav-chart sidebar-note ad-industry".split()
#: Boilerplate by kind: tags it comes in, class and id names, whether it is mostly links.
_KINDS = {
    "menu": ("nav nav div ul header", "nav navbar navigation main-nav menu main-menu site-nav topnav breadcrumb breadcrumbs toc-links pagination pager", 1.0),
    "header": ("header header div", "header site-header page-header masthead topbar top-bar branding", 0.6),
    "footer": ("footer footer div", "footer site-footer page-footer copyright colophon legal footer-links bottom", 0.5),
    "sidebar": ("aside aside div", "sidebar side-bar side widget widget-area right-rail rail secondary complementary most-read trending popular", 0.7),
    "related": ("aside div section", "related related-posts related-articles recommended more-stories read-more teasers see-also also-like", 0.7),
    "advert": ("div div aside ins section", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion ad-slot ad-container banner-ad outbrain taboola", 0.2),
    "comments": ("div section ol article div", "comments comment comment-list commentlist comment-body comment-text comments-area respond reply replies discussion disqus user-comments reader-comments", 0.1),
    "share": ("div ul div", "share sharing share-buttons social social-share social-links share-bar follow-us share-tools", 0.9),
    "newsletter": ("form div section", "newsletter newsletter-signup subscribe subscription signup sign-up mailing-list", 0.1),
    "notice": ("div div section dialog", "cookie cookies cookie-notice cookie-banner consent gdpr notice notification alert popup modal overlay banner paywall disclaimer", 0.2),
    "meta": ("footer footer div p ul", "entry-meta post-meta meta entry-footer article-footer byline tags tag-list categories author-box post-tags", 0.5),
    "form": ("form form div", "search search-form form login login-form contact-form register poll", 0.1),
}


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.bare = self.r.random() < 0.2  # a page whose main text nothing names
        self.html: list[str] = []
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(_WORDS, k=self.r.randint(low, high))).capitalize() + self.r.choice([".", ".", "", "!"])

    def names(self, names: list[str], often: float = 0.8) -> str:
        if self.r.random() > often or self.bare and names in (_CONTENT, _WRAPPER, _PLAIN_WRAPPER):
            return ""
        kind = self.r.choice(["class", "class", "class", "id"])
        chosen = self.r.sample(names, self.r.choice([1, 1, 2]))
        if names not in (_MIXED, _WRAPPER, _PLAIN_WRAPPER):  # names of many sites: only their parts are known
            chosen = [x if self.r.random() < 0.5 else self.r.choice([f"{x}-{self.r.choice(_AFFIX)}", f"{x}_{self.r.choice(_AFFIX)}", f"{self.r.choice(_AFFIX)}-{x}"]) for x in chosen]
        return f' {kind}="{" ".join(chosen)}"'

    def block(self, tag: str, text: str, attributes: str = "") -> None:
        """A block of the main text, sometimes with links or marks inside."""
        at = self.r.random()
        words = text.split(" ")
        if len(words) > 4 and at < 0.4:
            i = self.r.randrange(1, len(words) - 2)
            inner = self.r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", '<span class="mark">{}</span>']).format(" ".join(words[i : i + 2]))
            shown = " ".join([*words[:i], inner, *words[i + 2 :]])
        else:
            shown = text if at < 0.97 else f'<a href="/all">{text}</a>'
        self.html.append(f"<{tag}{attributes}>{shown}" + (f"</{tag}>" if tag != "p" or self.r.random() < 0.9 else ""))
        self.main.append(text)

    def boilerplate(self, kind: str) -> None:
        tags, names, links = _KINDS[kind]
        tag = self.r.choice(tags.split())
        plain = tag in ("div", "section", "ul", "ol", "ins", "article")
        self.html.append(f"<{tag}{self.names(names.split(), 1.0 if plain else 0.5)}>")
        if kind in ("related", "sidebar", "comments", "menu") and self.r.random() < 0.6:
            self.html.append(f"<h3>{self.words(1, 4)}</h3>")
        for _ in range(self.r.randint(1, 7)):
            text = self.words(1, 4) if links > 0.4 else self.words(2, 30)
            text = f'<a href="/l">{text}</a>' if self.r.random() < links else text
            if kind == "comments":
                inner = self.r.choice(["div", "article", "li"])
                name = self.r.choice([' class="comment"', "", "", ""])
                self.html.append(f"<{inner}{name}><p>{text}</p></{inner}>" if self.r.random() < 0.6 else f"<p>{text}</p>")
            elif kind == "related" and self.r.random() < 0.4:
                self.html.append(f"<article><h3>{text}</h3><p>{self.words(5, 20)}</p></article>")
            else:
                inner = "li" if tag in ("ul", "ol") or links > 0.4 and self.r.random() < 0.7 else self.r.choice(["p", "span", "div"])
                self.html.append(f"<{inner}>{text}</{inner}>")
        if kind in ("form", "newsletter"):
            self.html.append(f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>")
        self.html.append(f"</{tag}>")

    def text(self) -> None:
        headed = self.r.random()
        if headed < 0.3:
            self.html.append(f"<header{self.names(_TITLE, 0.9)}>")
            self.block("h1", self.words(3, 9))
            self.html.append("</header>")
        elif headed < 0.9:
            self.block("h1", self.words(3, 9), self.names(_TITLE, 0.3))
        for _ in range(self.r.randint(2, 14)):
            at = self.r.random()
            if at < 0.70:
                self.block("div" if self.bare and self.r.random() < 0.3 else "p", self.words(1, 60))
            elif at < 0.78:
                self.block(self.r.choice(["h2", "h3"]), self.words(2, 6))
            elif at < 0.84:
                self.html.append("<ul>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("li", self.words(2, 15))
                self.html.append("</ul>")
            elif at < 0.88:
                self.block("blockquote", self.words(5, 30))
            elif at < 0.91:
                self.html.append("<table><tr>")
                for _ in range(3):
                    self.block("td", self.words(1, 4))
                self.html.append("</tr></table>")
            elif at < 0.92:
                self.block(self.r.choice(["div", "section", "p"]), self.words(5, 40), self.names(_MIXED, 1.0))
            else:
                self.boilerplate(self.r.choice(["advert", "advert", "share", "newsletter", "related", "notice", "comments", "form", "sidebar"]))
        if self.r.random() < 0.3:
            self.boilerplate("meta")

    def build(self) -> tuple[str, list[str]]:
        around = [f"<div{self.names(_WRAPPER)}>" for _ in range(self.r.randint(0, 2))]
        self.html += around  # around everything, so it says nothing
        for kind in self.r.sample(["menu", "header", "notice", "advert", "share", "form"], self.r.randint(1, 4)):
            self.boilerplate(kind)
        if self.r.random() < 0.3:  # loose text that nothing names
            self.html.append(f"<div>{self.words(1, 4)}</div>")
        opened = []
        for _ in range(self.r.randint(0, 1)):
            self.html.append(f"<div{self.names(_PLAIN_WRAPPER)}>")
            opened.append("div")
        for _ in range(self.r.randint(1, 2)):
            tag = self.r.choice(["article", "main", "div", "div", "section", "td"])
            self.html.append(f"<table><tr><td{self.names(_CONTENT, 0.5)}>" if tag == "td" else f"<{tag}{self.names(_CONTENT, 0.5)}>")
            opened.append(tag)
        self.text()
        for tag in reversed(opened):
            self.html.append("</td></tr></table>" if tag == "td" else f"</{tag}>")
        for kind in self.r.sample(["sidebar", "related", "comments", "share", "advert", "newsletter", "footer", "menu"], self.r.randint(2, 6)):
            self.boilerplate(kind)
        self.html += ["</div>"] * len(around)
        head = f"<html><head><title>{self.words(2, 6)}</title></head><body{self.names(_WRAPPER, 0.3)}>"
        return head + "".join(self.html) + "</body></html>", self.main


def labelled_pages(n: int = 600, seed: int = 1) -> list[tuple[str, list[str]]]:
    """(html, blocks of the main text) of ``n`` pages."""
    return [_Page(1_000 * seed + i).build() for i in range(n)]
