"""Labelled pages made by rule, on which the block labeller is trained."""

from __future__ import annotations

import numpy as np

# Names that sites give to their parts. A page takes some of them at random.
MAIN = "content post entry article story body main text page-content article-body entry-content post-content story-body single blog-post prose markdown".split()
PARTS = {
    "nav": "nav menu navbar navigation main-menu top-menu breadcrumb breadcrumbs crumbs pagination tabs toolbar skip-links language-switcher".split(),
    "header": "header site-header masthead topbar top-bar banner-top branding logo site-title hero-bar".split(),
    "footer": "footer site-footer foot bottom bottom-bar copyright legal colophon imprint credits".split(),
    "aside": "sidebar side aside rail right-rail widget widgets secondary related related-posts recommended more-stories trending popular most-read tags tag-cloud author-box bio".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner ad-slot adbox commercial partner outbrain taboola".split(),
    "notice": "cookie cookies cookie-notice consent gdpr notice alert paywall subscribe newsletter modal popup overlay banner-notice disclaimer-bar signup toast".split(),
    "comment": "comments comment comment-list comment-body discussion replies reply responses disqus reviews respond".split(),
    "form": "form search search-form login signup contact-form subscribe-form newsletter-form".split(),
    "share": "share social social-share sharing share-buttons tools follow meta byline-tools print".split(),
}
SAID = {
    "nav": "home about contact login news sports world archive next previous menu skip to content",
    "header": "welcome the daily site official home of",
    "footer": "copyright all rights reserved privacy policy terms imprint contact powered by © ·",
    "aside": "related articles read more popular trending tags about the author most read you may also like",
    "ad": "advertisement sponsored buy now offer sale click here shop deal",
    "notice": "we use cookies accept consent privacy settings subscribe to our newsletter sign up agree close",
    "comment": "reply comment says posted by anonymous like report ago great post thanks",
    "form": "search name email message password submit send your",
    "share": "share tweet facebook email print follow us likes",
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class Maker:
    """Pages as HTML in which each text of the article carries a mark, so that the parser's blocks can be labelled."""

    MARK = "qqmainqq"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        syllables = ["".join(x) for x in zip(self.r.choice(list("bcdfghklmnprstvwz"), 400), self.r.choice(list("aeiouäéèóíñü"), 400), strict=True)]
        self.words = ["".join(self.r.choice(syllables, self.r.integers(1, 5))) for _ in range(3000)]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def pick(self, x):
        return x[int(self.r.integers(len(x)))]

    def prose(self, lo: int, hi: int) -> str:
        n = int(np.exp(self.r.uniform(np.log(lo), np.log(hi))))
        out = [self.pick(self.words) for _ in range(n)]
        if self.chance(0.3):
            out = [w + self.pick(["", "", "!!", "***", "$$$", "###", "&amp;&amp;", "%%%", " |"]) for w in out]
        if self.chance(0.08):
            out = [w.upper() for w in out]
        out[0] = out[0].capitalize()
        for _ in range(n // 12):
            out[int(self.r.integers(n))] += self.pick([",", ".", ";", ":", "?"])
        return " ".join(out) + self.pick([".", ".", "", "!"])

    def main_text(self, lo: int, hi: int) -> str:
        text = self.prose(lo, hi)
        if self.chance(0.2):
            words = text.split(" ")
            k = int(self.r.integers(len(words)))
            words[k] = f'<{self.pick(["b", "em", "i", "span"])}>{words[k]}' + self.pick(["</b>", "</em>", "</i>", "</span>", ""])
            if self.chance(0.5):
                words[-1] = f'<a href="/x">{words[-1]}</a>'
            text = " ".join(words)
        return f"{self.MARK} {text}"

    def attrs(self, kind: str, named: float = 0.9) -> str:
        if not self.chance(named):
            return ""
        name = self.pick(PARTS[kind])
        if self.chance(0.25):
            name += " " + self.pick(["box", "wrap", "container", "col", "row", "x1", "block"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def boiler(self, kind: str) -> str:
        said = SAID[kind].split()
        text = lambda a, b: " ".join(self.pick(said) if self.chance(0.35) else self.pick(self.words) for _ in range(int(self.r.integers(a, b))))
        plain = kind in TAGS and self.chance(0.6)
        tag = TAGS[kind] if plain else self.pick(["div", "section", "div", "aside" if kind in ("ad", "notice", "share") else "div"])
        attrs = self.attrs(kind, 0.3 if plain else 1.0)
        if kind == "nav":
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{text(1, 4)}</a></li>' for i in range(int(self.r.integers(3, 9)))) + "</ul>"
            inner = inner if self.chance(0.7) else " ".join(f'<a href="#">{text(1, 3)}</a>' for _ in range(5))
        elif kind == "form":
            tag = "form" if self.chance(0.8) else tag
            inner = f"<label>{text(1, 4)}</label><input name=q><p>{text(2, 12)}</p><button>{text(1, 3)}</button>"
        elif kind == "comment":
            one = lambda: f'<{self.pick(["div", "li", "article"])}{self.attrs(kind, 0.7)}><h4>{text(1, 4)}</h4><p>{self.prose(3, 60) if self.chance(0.7) else text(3, 20)}</p>'
            inner = f"<h3>{text(1, 4)}</h3>" + "".join(self._closed(one()) for _ in range(int(self.r.integers(1, 5))))
            attrs = attrs or ' class="comments"'
        elif kind == "aside":
            inner = f"<h3>{text(1, 4)}</h3>" + "".join(f'<p><a href="/r">{text(3, 10)}</a></p>' if self.chance(0.6) else f"<p>{self.prose(3, 30)}</p>" for _ in range(int(self.r.integers(1, 5))))
        else:
            body = self.prose(3, 25) if self.chance(0.6) else text(3, 20)
            if kind == "footer" and self.chance(0.6):
                body = f"&copy; {self.pick(self.words)}.example.com &middot; {body}"
            inner = body if self.chance(0.6) else f"<p>{body}</p>" + (f"<p>{text(2, 9)}</p>" if self.chance(0.4) else "")
        return f"<{tag}{attrs}>{inner}</{tag}>"

    @staticmethod
    def _closed(html: str) -> str:
        return f"{html}</{html[1:].split()[0].split('>')[0]}>"

    def article(self) -> str:
        r, out = self.r, []
        if self.chance(0.85):
            out.append(f"<h1>{self.main_text(2, 14)}</h1>")
        if self.chance(0.12):
            out.append(f'<header class="entry-header"><h2>{self.main_text(2, 10)}</h2></header>')
        for _ in range(int(np.exp(r.uniform(0, 2.8)))):
            x = r.random()
            if x < 0.62:
                out.append(f"<p>{self.main_text(1, 160)}</p>")
            elif x < 0.74:  # markup that isn't closed
                out.append(f"<p><b>{self.main_text(3, 60)}<br>")
            elif x < 0.79:
                out.append(f'<{self.pick(["h2", "h3"])}>{self.main_text(1, 8)}</h2>')
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.main_text(2, 25)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{self.main_text(5, 60)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.main_text(1, 5)}</td><td>{self.main_text(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.93:
                out.append(f"<div>{self.main_text(5, 90)}</div>")
            else:
                out.append(self.boiler(self.pick(["ad", "share", "aside", "notice", "form"])))
        if self.chance(0.15):
            out.append(self.boiler("comment"))
        inner = "".join(out)
        x = r.random()
        if x < 0.45:
            name = f' class="{self.pick(MAIN)}"' if self.chance(0.4) else ""
            return f"<article{name}>{inner}</article>"
        if x < 0.6:
            return f'<main{" id=main" if self.chance(0.5) else ""}>{inner}</main>'
        if x < 0.95:
            return f'<div {self.pick(["class", "id"])}="{self.pick(MAIN)}">{inner}</div>'
        return inner

    def page(self) -> str:
        some = lambda kinds, p: "".join(self.boiler(k) for k in kinds if self.chance(p))
        top = some(self.r.permutation(["header", "nav", "notice", "ad", "form", "nav"]), 0.4)
        low = some(["share", "aside", "comment", "ad", "form", "notice"], 0.3) + (self.boiler("footer") if self.chance(0.85) else "")
        mid = self.article()
        if self.chance(0.2):
            mid = f'<div class="{self.pick(["wrapper", "container", "layout", "page", "site"])}">{self.boiler("aside") if self.chance(0.5) else ""}{mid}{low}</div>'
            low = ""
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{top}{mid}{low}" + ("</body></html>" if self.chance(0.8) else "")
