"""Main text of web pages: a bidirectional LSTM labels every block in the context of its whole page.

A page is cut into blocks, runs of text without a block-level tag between them. Of each block the
network reads hashed features of its tag path (tags, classes and ids of all ancestors), hashed
words and a few measures; it is trained in numpy on pages that this module invents: articles
within menus, headers, footers, sidebars, notices, adverts, forms and reader comments, under many
names and layouts. Training is deterministic and takes seconds; the weights go to every task.

A null or empty page, or one without any block of the article, has an empty text. Repeated rows
are extracted each. Very long pages are read whole. Extra columns are dropped; an empty table gives no rows. A line break
element ends a block. What is in formulas, objects and elements for pages without scripts is labelled like any other block.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .words import SPACED, words

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 256, 24, 6, 32
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 3000, 14, 64, 6e-3, 11

#: Elements that part blocks, that hold no readable text, that have no end tag, and that end an open one of their kind.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe input "
    "label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio object".split()
)
SILENT = frozenset("script style template svg iframe textarea select".split())
RAW = frozenset("script style textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "button", "label", "input", "option", "select", "textarea", "video", "audio", "object", "iframe"}

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, letters within links) of each block with text, in page order.

    A step of the path is a tag and the parts of its class, id and role, joined by spaces.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = quiet = 0
    path: tuple[str, ...] = ()

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((path, text, linked))
            held.clear()
        linked = 0

    def pop(i: int) -> None:
        nonlocal quiet
        quiet -= sum(t in SILENT for t, _ in stack[i:])
        del stack[i:]

    def say(text: str) -> None:
        nonlocal path, linked
        if not quiet and text:
            if "&" in text:
                text = html.unescape(text)
            if not held:
                path = tuple(s for _, s in stack)
            held.append(text)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag does not end a block
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in ENDED_BY:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDED_BY[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "article", "body"):
                    break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        names = " ".join(p.lower() for a in _NAMED.finditer(m[3]) for p in _PARTS.findall(a[2] or a[3] or a[4] or "")) if "=" in m[3] else ""
        stack.append((tag, f"{tag} {names}" if names else tag))
        quiet += tag in SILENT
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
    close()
    return out


def _spread(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % PATH_DIMS, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(maxsize=50_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags, names, and name parts of a path, and its innermost steps."""
    v = np.zeros(PATH_DIMS, np.float32)
    seen = set()
    for step in path:
        tag, *names = step.split()
        seen.add("t:" + tag)
        seen.update("n:" + n for n in names)
    if path:
        seen.add("leaf:" + path[-1].split()[0])
        seen.add("up:" + (path[-2].split()[0] if len(path) > 1 else ""))
    for feature in seen:
        for turn in ("", "~"):
            i, sign = _spread(feature + turn)
            v[i] += sign
    return v


def inputs(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """(blocks, DIMS) inputs of one page."""
    return batch_inputs([page])[0]


def batch_inputs(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
    flat = [b for page in pages for b in page]
    n = len(flat)
    x = np.zeros((n, DIMS), np.float32)
    if n:
        x[:, :PATH_DIMS] = np.stack([path_vector(p) for p, _, _ in flat])
        at = 0
        count = np.zeros(n)
        for w in words(pa.array([t for _, t, _ in flat]), SPACED):
            owner = np.repeat(np.arange(w.texts), np.diff(w.bounds)) + w.first
            slot = (w.hash % np.uint64(WORD_DIMS)).astype(np.int64)
            sign = np.where(w.hash >> np.uint64(63), 1.0, -1.0)
            x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] += np.bincount(owner * WORD_DIMS + slot, sign, n * WORD_DIMS).reshape(n, WORD_DIMS).astype(np.float32)
            count += np.bincount(owner, minlength=n)
        x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] *= (0.3 / np.sqrt(np.maximum(count, 1)))[:, None]
        size = np.array([len(t) for _, t, _ in flat])
        stops = np.array([t.endswith((".", "!", "?", ":", "…")) for _, t, _ in flat])
        at = np.concatenate([np.arange(len(p)) for p in pages if p])
        of = np.concatenate([np.full(len(p), len(p)) for p in pages if p])
        measures = (np.log1p(count) / 4, np.array([a for _, _, a in flat]) / np.maximum(size, 1), stops, at / of, at == 0, np.array([len(p) for p, _, _ in flat]) / 8)
        x[:, PATH_DIMS + WORD_DIMS :] = np.stack(measures, axis=1)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1]) if pages else []


class Labeller:
    """One LSTM in each direction and a logistic output over both."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {f"{d}{n}": v for d in "fb" for n, v in (("W", draw(DIMS, 4 * HIDDEN)), ("U", draw(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.p[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p["o"] = draw(2 * HIDDEN, 1)
        self.p["z"] = np.zeros(1, np.float32)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(p) for p in pages)
        x, mask = np.zeros((t, len(pages), DIMS), np.float32), np.zeros((t, len(pages), 1), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i], mask[: len(p), i] = p, 1
        return x, mask

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, learning: bool = True) -> tuple[np.ndarray, list]:
        t, n, _ = x.shape
        drive = x @ self.p[f"{d}W"] + self.p[f"{d}c"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((t, n, HIDDEN), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = drive[i] + h @ self.p[f"{d}U"]
            s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            g = np.tanh(a[:, 3 * HIDDEN :])
            new = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
            squashed = np.tanh(new)
            if learning:
                trace.append((i, h, c, s, g, squashed))
            m = mask[i]
            c = m * new + (1 - m) * c
            h = m * s[:, 2 * HIDDEN :] * squashed + (1 - m) * h
            out[i] = h
        return out, trace

    def _back(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list, grad: np.ndarray, into: dict) -> None:
        t, n, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        da = np.zeros((t, n, 4 * HIDDEN), np.float32)
        for i, h, c, s, g, squashed in reversed(trace):
            m = mask[i]
            dh = dh + grad[i]
            live = dh * m
            dnew = dc * m + live * s[:, 2 * HIDDEN :] * (1 - squashed**2)
            ds = np.concatenate([dnew * g, dnew * c, live * squashed], axis=1) * s * (1 - s)
            da[i] = np.concatenate([ds, dnew * s[:, :HIDDEN] * (1 - g**2)], axis=1)
            into[f"{d}U"] += h.T @ da[i]
            dc = dc * (1 - m) + dnew * s[:, HIDDEN : 2 * HIDDEN]
            dh = dh * (1 - m) + da[i] @ self.p[f"{d}U"].T
        into[f"{d}W"] += x.reshape(t * n, -1).T @ da.reshape(t * n, -1)
        into[f"{d}c"] += da.sum(axis=(0, 1))

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["o"] + self.p["z"])[..., 0]

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss of a batch and the gradients."""
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"])))
        n = mask.sum()
        y = y[..., None]
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
        d = mask * (p - y) / n
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = np.einsum("tnh,tnk->hk", both, d)
        grads["z"] = d.sum(axis=(0, 1))
        back = d @ self.p["o"].T
        for i, way in enumerate("fb"):
            self._back(way, x, mask, runs[way][1], back[..., i * HIDDEN : (i + 1) * HIDDEN], grads)
        return float(loss), grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block belongs to the article; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            most = max(1, min(256, 40_000 // max(1, len(pages[order[min(at + 255, len(order) - 1)]]))))
            some = order[at : at + most]
            at += most
            x, mask = self.padded([pages[i] for i in some])
            z = self.logits(x, mask)
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k] > 0
        return out


class Inventor:
    """Invented pages and which of their blocks are the article."""

    MAIN = ("article", "main", "main article", "div.content", "div.post", "div.entry-content", "div#content", "div.article-body", "section.story", "div.main div.text", "td.content", "div.post-content", "div#main article", "div.body", "article.post", "div[role=main]", "section", "div.page div.column")
    MENU = ("nav", "div.menu", "div#nav", "ul.nav", "div.navbar", "nav.main-menu", "div.breadcrumbs", "div.navigation", "ul.menu", "div#menu", "nav.breadcrumb", "div.topbar", "div[role=navigation]", "div.pagination")
    HEADER = ("header", "div.header", "div#header", "header.site-header", "div.masthead", "div.banner", "div#top", "div.logo", "div[role=banner]")
    FOOTER = ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom", "div[role=contentinfo]", "div.legal")
    SIDE = ("aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "div.right-column", "div.widget-area", "section.related-posts", "div.recommended", "div.trending", "div[role=complementary]", "div.social", "div.share", "ul.share-buttons", "div.tags", "div.newsletter")
    NOTICE = ("div.notice", "div.cookie-banner", "div#cookies", "div.alert", "div.gdpr", "div.consent", "div.warning", "p.notice", "div.popup", "div.modal", "section.notice", "div.subscribe", "div.paywall", "div.disclaimer", "div.cookie-notice")
    ADVERT = ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div#ad-top", "section.sponsor", "div.banner-ad", "p.ad", "div.adsense", "div.ad-slot", "ins.ad", "div.promotion")
    FORM = ("form", "form.search", "form#login", "form.subscribe", "div.search form", "form.contact", "div.login")
    COMMENTS = ("div.comments", "section#comments", "div#comments", "ol.comment-list", "ul.comments", "div.comment-section", "section.comments", "div.disqus", "div.responses", "div.replies", "section.discussion", "div.reader-comments", "div.comment", "article.comment")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = [self.r.choice("bcdfghjklmnprstvwz") * (self.r.random() < 0.8) + self.r.choice("aeiouéöü") + self.r.choice(["", "n", "r", "s", "nd", "t"]) for _ in range(220)]
        self.common = ["".join(self.r.choices(self.syllables, k=1)) for _ in range(60)]

    def word(self) -> str:
        return self.r.choice(self.common) if self.r.random() < 0.45 else "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))

    def prose(self, low: int, high: int) -> str:
        out, start = [], True
        for _ in range(self.r.randint(low, high)):
            w = self.word()
            out.append(w.capitalize() if start else w)
            start = self.r.random() < 0.09
            if start:
                out[-1] += self.r.choice(".....!?")
            elif self.r.random() < 0.08:
                out[-1] += ","
        text = " ".join(out)
        return text + "." if self.r.random() < 0.8 and not text.endswith((".", "!", "?")) else text

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and self.r.random() < 0.35:
            i = self.r.randrange(len(parts))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a href='/x'", "code", "sup"])
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>" if self.r.random() < 0.9 else f"<{tag}>{parts[i]}"
        return " ".join(parts)

    def wrap(self, spec: str, body: str) -> str:
        for step in reversed(spec.split()):
            m = re.match(r"(\w+)(?:\.([\w-]+))?(?:#([\w-]+))?(?:\[role=(\w+)\])?", step)
            names = (f' class="{m[2]}"' if m[2] else "") + (f' id="{m[3]}"' if m[3] else "") + (f' role="{m[4]}"' if m[4] else "")
            if self.r.random() < 0.1 and not m[2]:
                names += f' class="{self.word()}"'
            body = f"<{m[1]}{names}>{body}</{m[1]}>"
        return body

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.prose(1, 4) if self.r.random() < 0.3 else self.word()}</a>' for _ in range(self.r.randint(low, high))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if kind < 0.8 else " ").join(items) if kind < 0.9 else "".join(f"<div>{i}</div>" for i in items)

    def lines(self, low: int, high: int, most: int = 40) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            t = self.inline(self.prose(1, most))
            out.append(f"<p>{t}</p>" if self.r.random() < 0.6 else f"<div>{t}</div>" if self.r.random() < 0.5 else t)
        return "\n".join(out)

    def side(self, kind: str) -> str:
        r = self.r
        spec = r.choice(getattr(self, kind))
        if kind == "MENU":
            return self.wrap(spec, self.links(2, 9))
        if kind == "HEADER":
            return self.wrap(spec, (f"<h1>{self.prose(1, 5)}</h1>" if r.random() < 0.5 else f"<a href='/'>{self.word()}</a>") + (self.links(1, 5) if r.random() < 0.4 else f"<p>{self.prose(2, 12)}</p>" * (r.random() < 0.6)))
        if kind == "FOOTER":
            return self.wrap(spec, r.choice(["&copy; ", "© 2020 ", ""]) + f"{self.word()}.example &middot; {self.prose(2, 25)}" if r.random() < 0.6 else self.lines(1, 3, 20) + self.links(1, 5))
        if kind == "FORM":
            return self.wrap(spec, f"<label>{self.prose(1, 4)}</label><input name='{self.word()}'><button>{self.word()}</button>" + (f"<p>{self.prose(3, 20)}</p>" if r.random() < 0.4 else "") + ("<select><option>a<option>b</select>" if r.random() < 0.2 else ""))
        if kind == "COMMENTS":
            rows = []
            for _ in range(r.randint(1, 5)):
                by = f"<{(t := r.choice(['b', 'cite', 'h4', 'span', 'p']))}>{self.word()}</{t}>" if r.random() < 0.6 else ""
                rows.append(r.choice(["<li>{}</li>", "<div class='comment'>{}</div>", "<div>{}</div>", "<article>{}</article>", "{}"]).format(by + f"<p>{self.inline(self.prose(2, 60))}</p>"))
            return self.wrap(spec, (f"<h3>{self.prose(1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(rows))
        if kind == "SIDE":
            return self.wrap(spec, (f"<h3>{self.prose(1, 4)}</h3>" if r.random() < 0.5 else "") + (self.links(2, 6) if r.random() < 0.6 else self.lines(1, 3, 40)))
        text = self.inline(self.prose(2, 40))
        return self.wrap(spec, text if r.random() < 0.6 else f"<p>{text}</p>" + (f"<button>{self.word()}</button>" if r.random() < 0.3 else ""))

    def article(self) -> list[str]:
        r = self.r
        out = [f"<h1>{self.prose(2, 10)}</h1>"] if r.random() < 0.8 else []
        many = 4 if r.random() < 0.8 else 25
        for _ in range(r.randint(1, many)):
            kind = r.random()
            text = self.inline(self.prose(1, 6 if r.random() < 0.25 else 120))
            if kind < 0.72:
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p><b>{text}<br>" if r.random() < 0.5 else f"<p>{text}")
            elif kind < 0.80:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.prose(1, 7)}</h{k}>")
            elif kind < 0.88:
                out.append(f"<{(k := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.prose(1, 25))}</li>" for _ in range(r.randint(1, 6))) + f"</{k}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{'<p>' if r.random() < 0.5 else ''}{text}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.prose(1, 5)}</td>" for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.prose(2, 15)}</figcaption></figure>")
            else:
                out.append(f"<pre>{text}</pre>" if r.random() < 0.5 else f"<div>{text}</div>")
        return out

    def page(self) -> tuple[str, list[bool]]:
        """A page and for each of its blocks whether it is the article's."""
        r = self.r
        some = lambda kinds, p: [(self.side(k), False) for k in kinds if r.random() < p]
        before = some(["NOTICE"], 0.25) + some(["HEADER"], 0.4) + some(["MENU"], 0.7) + some(["ADVERT"], 0.4) + some(["SIDE"], 0.2) + some(["FORM"], 0.2)
        after = some(["ADVERT"], 0.25) + some(["COMMENTS"], 0.4) + some(["SIDE"], 0.4) + some(["FORM"], 0.2) + some(["NOTICE"], 0.2) + some(["MENU"], 0.15) + some(["FOOTER"], 0.8)
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        body = [(b, True) for b in self.article()]
        for kind, p in (("ADVERT", 0.2), ("SIDE", 0.15), ("NOTICE", 0.1), ("FORM", 0.1), ("COMMENTS", 0.08), ("HEADER", 0.06), ("FOOTER", 0.06), ("MENU", 0.06)):
            if r.random() < p:
                body.insert(len(body) if kind in ("COMMENTS", "FOOTER") else 0 if kind == "HEADER" else r.randint(0, len(body)), (self.side(kind), False))
        mark = "{}"
        labels: list[bool] = []

        def marked(parts: list[tuple[str, bool]]) -> str:
            done = []
            for part, main in parts:
                labels.append(main)
                done.append(f"<!--{len(labels) - 1}-->" + part)
            return "".join(done)

        head = f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{self.prose(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' if r.random() < 0.9 else ""
        first = marked(before)
        middle = self.wrap(r.choice(self.MAIN), marked(body)) if r.random() < 0.97 else marked(body)
        if r.random() < 0.4:
            first, middle = "", self.wrap(r.choice(["div.wrapper", "div#page", "div.container", "div.row", "table tr td", "div"]), first + middle)
        page = head + first + middle + marked(after) + ("</body></html>" if head and r.random() < 0.9 else "")
        if r.random() < 0.05:
            page = page[: int(len(page) * r.uniform(0.5, 0.99))]
        return self._labelled(page, labels)

    def _labelled(self, page: str, labels: list[bool]) -> tuple[str, list[bool]]:
        """Find the blocks of each part: parts are told apart by a sign in their texts."""
        signed = re.sub(r"<!--(\d+)-->", lambda m: f"<hr><wbr data-n={m[1]}>", page)
        out = []
        pieces = re.split(r"<hr><wbr data-n=(\d+)>", signed)
        clean = pieces[0]
        counts = [(None, len(blocks(clean)))]
        for number, body in zip(pieces[1::2], pieces[2::2], strict=True):
            clean += "<hr>" + body
            counts.append((int(number), len(blocks(clean))))
        before = 0
        for number, n in counts:
            out += [number is not None and labels[number]] * (n - before)
            before = n
        return clean, out


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller, fitted to TRAIN_PAGES invented pages."""
    inventor, net = Inventor(SEED), Labeller()
    pages = []
    while len(pages) < TRAIN_PAGES:
        page, labels = inventor.page()
        cut = blocks(page)
        if cut and len(cut) == len(labels):
            pages.append((inputs(cut), np.array(labels, np.float32)))
    order = random.Random(SEED)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order.shuffle(pages)
        batches = sorted((sorted(pages[i : i + 8 * BATCH], key=lambda p: len(p[0]))[j : j + BATCH] for i in range(0, len(pages), 8 * BATCH) for j in range(0, 8 * BATCH, BATCH)), key=lambda _: order.random())
        for some in batches:
            if not some:
                continue
            x, mask = net.padded([p for p, _ in some])
            y = np.zeros(mask.shape[:2], np.float32)
            for i, (_, labels) in enumerate(some):
                y[: len(labels), i] = labels
            _, grads = net.learn(x, mask, y)
            step += 1
            rate = RATE * (1 - 0.9 * step / (EPOCHS * TRAIN_PAGES / BATCH + 1))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def texts(net: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    kept = net.label(batch_inputs(cut))
    return ["\n".join(t for (_, t, _), k in zip(page, keep, strict=True) if k) for page, keep in zip(cut, kept, strict=True)]


def _extracted(weights: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net = Labeller()
    net.p = weights
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = texts(net, [p or "" for p in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    bound_batches(pages.sparkSession)
    weights = trained().p
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extracted(weights, it), "page_id long, url string, text string, n_chars long")
