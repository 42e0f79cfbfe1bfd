"""Composed web pages to fit the extractor on: many plans, each main text marked by U+E000 in front of its blocks."""

from __future__ import annotations

import random

#: What attribute tokens say about an element.
GROUPS = {
    "menu": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs pagination pager tabs toc sitemap skip",
    "header": "header masthead topbar top branding logo hero site",
    "footer": "footer bottom copyright legal colophon credits imprint foot",
    "side": "sidebar side aside widget widgets rail related recommended popular trending latest more tags categories archive archives recent readnext",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay subscribe newsletter paywall signup message toast disclaimer promo notification",
    "advert": "ad ads advert adverts advertisement sponsor sponsored sponsors dfp promoted outbrain taboola affiliate commercial adsense adslot",
    "form": "form search login contact register input field",
    "comment": "comment comments reply replies respond discussion disqus thread responses reader feedback commentlist",
    "share": "share sharing social follow author byline meta bio facebook twitter tools print",
    "main": "article content main post entry story text body prose markdown page articlebody maincontent primary copy",
}
GROUPS = {k: v.split() for k, v in GROUPS.items()}
NEUTRAL = "box wrap wrapper container row col inner outer block panel item c1 x2 grid unit module region".split()
MARK = "\ue000"
SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qui re sa ti ul ve wo ya ze th er on ing tion".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(1, 18)
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + self.r.choice("....!?")

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def attrs(self, group: str, sure: float = 0.75) -> str:
        x = self.r.random()
        if x > sure:
            return self.r.choice(["", f' class="{self.r.choice(NEUTRAL)}"', f' id="{self.r.choice(NEUTRAL)}{self.r.randint(1, 99)}"'])
        t = self.r.choice(GROUPS[group])
        name = self.r.choice([t, t, f"{t}-{self.r.choice(NEUTRAL)}", f"{self.r.choice(NEUTRAL)}_{t}", f"{self.r.choice(NEUTRAL)}{t.capitalize()}"])
        return f' {self.r.choice(["class", "class", "id", "role"])}="{name}"'

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(a, b))]
        kind = self.r.randint(0, 3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items) if kind == 2 else "".join(f"<div>{x}</div>" for x in items)

    def element(self, tags: list[str], group: str, inside: str, sure: float = 0.75) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attrs(group, 1.0 if tag in ('div', 'p', 'section') and sure > 0.7 and self.r.random() < 0.8 else sure)}>{inside}</{tag}>"

    # what is not main text

    def menu(self) -> str:
        return self.element(["nav", "nav", "div", "ul"], "menu", self.links(2, 12))

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 9)}</p>", f"{self.words(1, 5)}"])
        return self.element(["header", "header", "div"], "header", inside + (self.menu() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inside = f"&copy; {self.word()}.example {self.r.choice(['&middot;', '|', '2024'])} {self.prose(1, 4)}"
        if self.r.random() < 0.5:
            inside = f"<p>{inside}</p>"
        return self.element(["footer", "footer", "div"], "footer", inside + (self.links(2, 7) if self.r.random() < 0.4 else ""))

    def side(self) -> str:
        title = self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h4>{self.words(1, 3)}</h4>"])
        body = self.r.choice([self.links(2, 10), f"<p>{self.prose(1, 5)}</p>", "".join(f"<p><a href='/{self.word()}'>{self.words(3, 9)}</a></p>" for _ in range(self.r.randint(2, 6))), self.prose(1, 4)])
        return self.element(["aside", "aside", "div", "section"], "side", title + body)

    def notice(self) -> str:
        inside = self.r.choice([self.prose(1, 4), f"<p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 3)}</p><a href='/ok'>{self.word()}</a><button>{self.word()}</button>"])
        return self.element(["div", "div", "section", "aside", "p"], "notice", inside if "<p" not in inside else inside)

    def advert(self) -> str:
        inside = self.r.choice([self.prose(1, 5), f"<p>{self.prose(1, 4)}</p>", f"<a href='/x'>{self.words(2, 12)}</a>", f"<b>{self.words(1, 3)}</b> {self.prose(1, 2)}"])
        return self.element(["div", "div", "aside", "section"], "advert", inside, 0.95)

    def form(self) -> str:
        inside = f"<label>{self.words(1, 3)}</label><input type=text> {self.words(0, 8)} <button>{self.word()}</button>"
        if self.r.random() < 0.4:
            inside = f"<p>{self.prose(1, 2)}</p>" + inside
        return self.element(["form", "form", "div"], "form", inside)

    def comments(self) -> str:
        one = lambda: self.element(["div", "li", "article", "p"], "comment", self.r.choice([f"<b>{self.word()}</b> {self.prose(1, 5)}", f"<span>{self.word()}</span><p>{self.prose(1, 6)}</p>", self.prose(1, 5)]), 0.8)
        title = self.r.choice(["", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.words(1, 2)}</h3>"])
        return self.element(["section", "div", "div", "ol", "aside"], "comment", title + "".join(one() for _ in range(self.r.randint(1, 8))), 0.97)

    def share(self) -> str:
        return self.element(["div", "ul", "p", "section"], "share", self.r.choice([self.links(2, 6), f"{self.words(1, 3)} <a href='/a'>{self.words(1, 2)}</a>", self.words(2, 6)]))

    def junk(self) -> str:
        return self.r.choice([self.menu, self.side, self.notice, self.advert, self.advert, self.form, self.share, self.notice])()

    # main text

    def inline(self, text: str) -> str:
        x = self.r.random()
        ws = text.split(" ")
        k = self.r.randrange(len(ws))
        if x < 0.15:
            ws[k] = f"<{(t := self.r.choice(['b', 'i', 'em', 'strong', 'code', 'span']))}>{ws[k]}</{t}>"
        elif x < 0.3:
            ws[k] = f'<a href="/{self.word()}">{ws[k]}</a>'
        return " ".join(ws)

    def paragraph(self) -> str:
        text = MARK + self.inline(self.prose(1, self.r.choice([1, 2, 4, 9])))
        x = self.r.random()
        if x < 0.1:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if x < 0.85 else f"<p>{text}"

    def block(self, plain: bool) -> str:
        x = self.r.random()
        if x < 0.72:
            return f"<div>{MARK}{self.inline(self.prose(1, 6))}</div>" if plain else self.paragraph()
        if x < 0.82:
            return f"<h{(k := self.r.randint(2, 4))}>{MARK}{self.words(1, 7)}</h{k}>"
        if x < 0.9:
            return "<ul>" + "".join(f"<li>{MARK}{self.inline(self.sentence())}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>"
        if x < 0.94:
            return f"<blockquote>{MARK}{self.prose(1, 3)}</blockquote>"
        if x < 0.97:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 5)}</td></tr>" for _ in range(self.r.randint(1, 5))) + "</table>"
        return f"<figure><img src=x><figcaption>{MARK}{self.words(3, 12)}</figcaption></figure>"

    def story(self) -> str:
        r, plain = self.r, self.r.random() < 0.12
        parts = [self.block(plain) for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
        title = f"<h1>{MARK}{self.words(2, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice([self.advert, self.advert, self.share, self.side, self.notice, self.form])())
        if r.random() < 0.1:
            parts.append(self.comments())
        if r.random() < 0.25:
            parts = [f"<div{self.attrs('main', 0.6)}>{''.join(parts)}</div>"]
        inside = title + "".join(parts)
        x = r.random()
        if x < 0.45:
            return f"<article{self.attrs('main', 0.5) if r.random() < 0.5 else ''}>{inside}</article>"
        if x < 0.6:
            return f"<main>{inside}</main>"
        if x < 0.9:
            return f"<{(t := r.choice(['div', 'div', 'section']))}{self.attrs('main', 0.85)}>{inside}</{t}>"
        return inside

    def page(self) -> str:
        r = self.r
        before = [self.header()] if r.random() < 0.5 else []
        before += [self.menu()] if r.random() < 0.7 else []
        before += [self.junk() for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        after = [self.junk() for _ in range(r.choice([0, 0, 1, 2, 3]))]
        if r.random() < 0.35:
            after.insert(0, self.comments())
        after += [self.footer()] if r.random() < 0.8 else []
        r.shuffle(before)
        middle = self.story()
        if r.random() < 0.4:
            middle = self.side() + middle if r.random() < 0.5 else middle + self.side()
            middle = f"<div{self.attrs('main', 0.3)}>{middle}</div>"
        inside = "".join(before) + middle + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = f'<div class="{r.choice(NEUTRAL)}">{inside}</div>'
        head = f"<!DOCTYPE html><html lang=en><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return (head if r.random() < 0.9 else "") + inside + r.choice(["</body></html>", ""])


def page(seed: int) -> str:
    return Maker(seed).page()
