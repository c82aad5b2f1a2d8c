"""Main text of web pages: boosted trees score DOM nodes, a pass over the tree makes the choices consistent."""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.boosting import Trees, fit_trees
from annalist.llm.common import lean, prepare

# Fixed values of the HTML standard: elements without content, elements whose content is no text to read, foreign elements,
# which a slash in their tag ends, inline elements, and elements that a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

#: Text beside block elements is an element of its own, of this tag.
RUN = "run"
TAGS = "run p div article main section nav header footer aside ul ol li h1 h2 h3 h4 table tr td form blockquote pre figure body dl".split()
AROUND = "article main nav header footer aside form ul table section".split()


class Page:
    """The block elements of a page in document order, and its runs of text.

    parent, tag, depth, tokens (of class, id, role) of each element; node, text, linked letters of each run.  An element has
    either one run of text and no elements inside, or elements alone: a run beside others is in an element RUN of its own.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.depth, self.tokens = [-1], ["body"], [0], [frozenset()]
        self.inner, self.controls, self.images = [0], [0], [0]  # inline elements, form controls, images right inside
        self.node: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._parse(source)
        self._unwrap()

    def _unwrap(self) -> None:
        """Runs that are all that an element has belong to it."""
        children = [0] * len(self.tag)
        for p in self.parent[1:]:
            children[p] += 1
        alone = [k > 0 and self.tag[k] == RUN and children[self.parent[k]] == 1 for k in range(len(self.tag))]
        number, n = [], 0
        for gone in alone:
            number.append(n)
            n += not gone
        self.node = [number[self.parent[k] if alone[k] else k] for k in self.node]
        for k, gone in enumerate(alone):
            if gone:
                for counts in (self.inner, self.controls, self.images):
                    counts[self.parent[k]] += counts[k]
        kept = [k for k, gone in enumerate(alone) if not gone]
        self.parent = [number[self.parent[k]] if k else -1 for k in kept]
        for name in ("tag", "depth", "tokens", "inner", "controls", "images"):
            values = getattr(self, name)
            setattr(self, name, [values[k] for k in kept])

    def _add(self, parent: int, tag: str, depth: int, tokens: frozenset[str]) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(depth)
        self.tokens.append(tokens)
        for counts in (self.inner, self.controls, self.images):
            counts.append(0)
        return len(self.tag) - 1

    def _parse(self, s: str) -> None:
        stack, buffer, linked, link, at, n = [0], [], 0, 0, 0, len(s)
        inner = controls = images = 0  # since the last run of text
        open_ended: set[str] = set()  # names without an end tag from here on

        def flush() -> None:
            nonlocal linked, inner, controls, images
            text = " ".join("".join(buffer).split()) if buffer else ""
            here = stack[-1]
            if text:
                here = self._add(here, RUN, len(stack), frozenset())
                self.node.append(here)
                self.text.append(text)
                self.linked.append(min(linked, len(text)))
            buffer.clear()
            self.inner[here] += inner
            self.controls[here] += controls
            self.images[here] += images
            linked = inner = controls = images = 0

        while at < n:
            m = TAG.search(s, at)
            begin = m.start() if m else n
            if begin > at:
                piece = s[at:begin]
                if "&" in piece:
                    piece = _html.unescape(piece)
                buffer.append(piece)
                if link:
                    linked += len(piece.strip())
            if not m:
                break
            if m[1]:
                end = s.find("-->", begin + 4)
                at = n if end < 0 else end + 3
                continue
            if m[2]:
                end = s.find(">", begin)
                at = n if end < 0 else end + 1
                continue
            at = m.end()
            close, name, attrs = (m[3], m[4].lower(), m[5]) if m[4] else (m[6], m[7].lower(), m[8])
            if name in RAW or name == "head" or name == "title":
                if name == "head":  # its text is in elements of their own, which are left out
                    continue
                if not close and not (name in FOREIGN and attrs.endswith("/")):
                    end = None if name in open_ended else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(s, at)
                    if not end:
                        open_ended.add(name)
                    at = end.end() if end else (n if name in ("script", "style", "title", "textarea") else at)
                    controls += name in ("select", "textarea", "button")
                continue
            if name in INLINE or name in VOID:
                inner += not close
                if name == "a":
                    link = 0 if close else 1
                elif name == "br" or name == "hr":
                    buffer.append(" ")
                    if name == "hr":
                        flush()
                elif name == "input":
                    controls += not close
                elif name == "img":
                    images += 1
                continue
            if name in ("html", "body"):
                if not close and name == "body" and attrs:
                    self.tokens[0] = tokens_of(attrs)
                flush()
                continue
            flush()
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        link = 0
                        break
                continue
            link = 0
            if name in ENDS_P and self.tag[stack[-1]] == "p":
                stack.pop()
            if name in ENDS:
                own, fence = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in own:
                        del stack[k:]
                    elif t in fence or t == "div":
                        break
            stack.append(self._add(stack[-1], name, len(stack), tokens_of(attrs) if "=" in attrs else frozenset()))
        flush()


def tokens_of(attrs: str) -> frozenset[str]:
    return frozenset(t for m in ATTR.finditer(attrs) for t in PART.findall((m[2] or m[3] or m[4] or "").lower()))


NUMBERS = "chars linked link_share inner per_element blocks stops controls images headings depth index siblings like_siblings before after sibling_mean parent_share page_share position children".split()


def node_features(pages: list[Page], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """A row per element of all pages, and where each page's begin (one more at the end).

    Of the subtree: letters, linked letters, elements, density, runs, full stops, controls, images, headings; depth, place
    among and likeness to siblings, their lengths; shares of parent and page; tag, ancestors' tags, attribute tokens, ancestors'
    attribute tokens.
    """
    begins = np.r_[0, np.cumsum([len(p.tag) for p in pages])].astype(np.int64)
    n = int(begins[-1])
    out = np.zeros((n, len(NUMBERS) + len(TAGS) + len(AROUND) + 2 * len(vocabulary) + 1), np.float32)
    tag_at, around_at, token_at = len(NUMBERS), len(NUMBERS) + len(TAGS), len(NUMBERS) + len(TAGS) + len(AROUND)
    above_at = token_at + len(vocabulary)
    tag_of, around_of = {t: k for k, t in enumerate(TAGS)}, {t: k for k, t in enumerate(AROUND)}
    for page, begin in zip(pages, begins, strict=False):
        m = len(page.tag)
        sums = [[0.0] * m for _ in range(6)]  # letters, linked, runs, stops, headings, elements
        for node, text, linked in zip(page.node, page.text, page.linked, strict=True):
            sums[0][node] += len(text)
            sums[1][node] += linked
            sums[2][node] += 1
            sums[3][node] += text.count(".") + text.count("!") + text.count("?")
        sums[5] = [1.0 + x for x in page.inner]
        controls, images = list(page.controls), list(page.images)
        children: list[list[int]] = [[] for _ in range(m)]
        for k in range(m - 1, 0, -1):
            p = page.parent[k]
            if page.tag[k] in ("h1", "h2", "h3", "h4"):
                sums[4][k] += 1
            for s in sums:
                s[p] += s[k]
            controls[p] += controls[k]
            images[p] += images[k]
            children[p].append(k)
        total = sums[0][0] or 1.0
        before, around, above = 0.0, [frozenset()] * m, [frozenset()] * m
        rows = out[begin : begin + m]
        own = [0.0] * m
        for node, text in zip(page.node, page.text, strict=True):
            own[node] += len(text)
        own_tokens = [frozenset(vocabulary[t] for t in tokens if t in vocabulary) if tokens else frozenset() for tokens in page.tokens]
        for k in range(m):
            p, chars = page.parent[k], sums[0][k]
            r = rows[k]
            r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[10] = chars, sums[1][k], sums[1][k] / (chars or 1.0), sums[5][k], chars / sums[5][k], sums[2][k], sums[3][k] / (chars or 1.0) * 100, controls[k], images[k], sums[4][k], page.depth[k]
            r[18], r[19], r[20] = chars / total, before / total, len(children[k])
            before += own[k]
            if p >= 0:
                r[17] = chars / (sums[0][p] or 1.0)
                around[k] = around[p] | {page.tag[p]}
                for t in around[k]:
                    if t in around_of:
                        r[around_at + around_of[t]] = 1
                above[k] = above[p] | own_tokens[p] if own_tokens[p] else above[p]
                for j in above[k]:
                    r[above_at + j] = 1
            if page.tag[k] in tag_of:
                r[tag_at + tag_of[page.tag[k]]] = 1
            for j in own_tokens[k]:
                r[token_at + j] = 1
            r[-1] = len(page.tokens[k]) - len(own_tokens[k])
        for kids in children:
            if kids:
                kids.reverse()
                mean = sum(sums[0][k] for k in kids) / len(kids)
                like: dict[str, int] = {}
                for k in kids:
                    like[page.tag[k]] = like.get(page.tag[k], 0) + 1
                for i, k in enumerate(kids):
                    r = rows[k]
                    r[11], r[12] = i, len(kids)
                    r[13] = like[page.tag[k]] / len(kids)
                    r[14] = sums[0][kids[i - 1]] if i else -1
                    r[15] = sums[0][kids[i + 1]] if i + 1 < len(kids) else -1
                    r[16] = mean
    return out, begins


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The most probable choice of elements in which no kept element lies in a dropped one."""
    m = len(page.tag)
    keep = np.minimum(-np.logaddexp(0, -margin), 0).tolist()
    drop = np.minimum(-np.logaddexp(0, margin), 0).tolist()
    all_drop, best = list(drop), list(keep)  # with the subtree; best: this element is kept
    for k in range(m - 1, 0, -1):
        p = page.parent[k]
        all_drop[p] += all_drop[k]
        best[p] += max(best[k], all_drop[k])
    kept = [False] * m
    for k in range(m):
        kept[k] = (k == 0 or kept[page.parent[k]]) and best[k] >= all_drop[k]
    return kept


def context(pages: list[Page], begins: np.ndarray, x: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """x with what the first trees say of an element, its parent, the siblings of its tag (their mean), and those on either side."""
    around = np.zeros((len(margin), 5), np.float32)
    around[:, 0] = margin
    for page, a in zip(pages, begins, strict=False):
        own = margin[a : a + len(page.tag)].tolist()
        last: dict[int, int] = {}
        sums: dict[tuple[int, str], list[float]] = {}
        for k in range(1, len(own)):
            p = page.parent[k]
            r = around[a + k]
            r[1] = own[p]
            total = sums.setdefault((p, page.tag[k]), [0.0, 0])
            total[0] += own[k]
            total[1] += 1
            if p in last:
                r[3] = own[last[p]]
                around[a + last[p], 4] = own[k]
            last[p] = k
        for k in range(1, len(own)):
            total = sums[page.parent[k], page.tag[k]]
            around[a + k, 2] = total[0] / total[1]
    return np.concatenate([x, around], 1)


@dataclass
class Extractor:
    trees: Trees
    refined: Trees
    vocabulary: dict[str, int]

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        x, begins = node_features(pages, self.vocabulary)
        margin = self.refined.margin(context(pages, begins, x, self.trees.margin(x)))
        out = []
        for page, a, b in zip(pages, begins[:-1], begins[1:], strict=True):
            kept = decode(page, margin[a:b])
            out.append("\n\n".join(t for node, t in zip(page.node, page.text, strict=True) if kept[node]))
        return out


@lru_cache(maxsize=2)
def fit_extractor(pages: int = 1600, seed: int = 7) -> Extractor:
    """Fit on ``pages`` labelled pages of many layouts, made here: an element is content if any of its text is.  Done once in a
    process."""
    made = [sample_page(random.Random(seed * 1_000_003 + k)) for k in range(pages)]
    parsed = [Page(s) for s, _ in made]
    counts: dict[str, int] = {}
    for p in parsed:
        for t in {t for own in p.tokens for t in own}:
            counts[t] = counts.get(t, 0) + 1
    vocabulary = {t: k for k, t in enumerate(sorted((t for t in counts if counts[t] >= 3), key=lambda t: (-counts[t], t))[:110])}
    x, begins = node_features(parsed, vocabulary)
    y = np.zeros(len(x))
    for page, (_, kept), a in zip(parsed, made, begins, strict=False):
        for node, text in zip(page.node, page.text, strict=True):
            if text in kept:
                while node >= 0:
                    y[a + node] = 1
                    node = page.parent[node]
    # the second trees learn from what the first ones say of pages that they haven't seen
    half = int(begins[len(parsed) // 2])
    unseen = np.concatenate([fit_trees(x[half:], y[half:], rounds=36).margin(x[:half]), fit_trees(x[:half], y[:half], rounds=36).margin(x[half:])])
    refined = fit_trees(context(parsed, begins, x, unseen), y, rounds=36)
    return Extractor(fit_trees(x, y, rounds=36), refined, vocabulary)


# ---- labelled pages

#: Words of class and id attributes, by what they stand for.
NAMES = {
    "content": "content article post entry story body text main news blog single page".split(),
    "menu": "nav menu navbar navigation links topbar breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header masthead top branding logo site".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "side": "sidebar aside widget rail secondary related recommended popular archive more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner promotion".split(),
    "notice": "cookie consent notice alert gdpr message popup modal warning newsletter subscribe".split(),
    "comments": "comment comments discussion replies reply respond disqus thread feedback".split(),
    "share": "share social sharing buttons follow".split(),
    "plain": "row col wrapper container inner box block grid left right outer wrap section x".split(),
}


def _words(r: random.Random, n: int) -> str:
    parts = ("the an er th on in re at es or ti ng ha ed is it al en ar le de un que la ción der ch ung ein ó é ä ñ к м 中 文".split())
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(n)]
    for i in range(0, n, max(3, r.randint(6, 16))):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += r.choice([".", ".", ".", "?", ","])
    if r.random() < 0.1:
        words = [w + r.choice(["%%%", "&amp;&amp;", "***", "$$$", "!!"]) for w in words]
    return " ".join(words) + (r.choice([".", ".", ""]) if n > 4 else "")


def sample_page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the runs of text that are its article."""
    kept: set[str] = set()

    def text(n: int, keep: bool) -> str:
        t = _words(r, n)
        if keep:
            kept.add(" ".join(_html.unescape(t).split()))
        return t

    style = r.choices(["p", "div", "section", "span", "breaks", "any"], [42, 28, 7, 6, 7, 10])[0]
    generated = r.random() < 0.25  # names of classes say nothing, here and there or all over the page

    def odd() -> str:
        """Names that a tool made up, or none."""
        if r.random() < 0.3:
            return ""
        name = r.choice(["css-", "sc-", "_", "x", "jsx-", "c", ""]) + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=r.randint(2, 7)))
        return f' {r.choice(["class", "class", "id"])}="{name if r.random() < 0.8 else r.choice(["hd", "bd", "ft", "txt", "t", "para", "p", "cnt", "main2", "l", "r"])}"'

    def attrs(kind: str, always: float = 0.8) -> str:
        if kind in ("content", "plain", "header", "footer", "menu") and (generated and r.random() < 0.9 or r.random() < 0.04):
            return odd()  # prose that is no article is only told by its names
        if r.random() > always:
            return ""
        names = r.sample(NAMES[kind], r.randint(1, 2))
        if r.random() < 0.3:
            names.append(r.choice(NAMES["plain"]))
        return f' {r.choice(["class", "class", "id"])}="{r.choice([" ", "-", "_"]).join(names)}"'

    def para(n: int, keep: bool) -> str:
        t = text(n, keep)
        kind = r.random()
        if kind < 0.12 and not any(c in t for c in "&"):
            words = t.split()
            k = r.randint(1, len(words))
            t = " ".join([*words[: k - 1], f"<{(tag := r.choice(['b', 'em', 'i', 'a href=\"/x\"', 'span']))}>{words[k - 1]}</{tag.split()[0]}>", *words[k:]])
        if 0.12 < kind < 0.2:  # tags that nothing ends
            return f"<p><{r.choice(['b', 'i', 'font', 'span', 'strong'])}>{t}{r.choice(['', '<br>', '<br/>'])}"
        if 0.2 < kind < 0.26 and keep:
            t = r.choice(["{}<button>OK</button>", "<input type=checkbox> {}", '{} <button class="copy">+</button>', "<img src=x> {}"]).format(t.replace("{", "").replace("}", ""))
        return f"<p>{t}</p>" if kind < 0.93 else f"<p>{t}"

    def stray() -> str:
        """A line beside blocks: names of pages, a date, a copyright."""
        bits = [text(r.randint(1, 2), False) for _ in range(r.randint(1, 6))]
        how = r.random()
        if how < 0.4:
            line = r.choice([" | ", " - ", " &raquo; ", " / "]).join(bits)
        elif how < 0.7:
            line = r.choice([" ", " | "]).join(f'<a href="/{k}">{b}</a>' for k, b in enumerate(bits))
        else:
            line = f"{r.choice(['&copy; ', '(c) ', ''])}{r.randint(1999, 2030)} {bits[0]}"
        if how < 0.4 or how >= 0.7:
            return line
        return line + r.choice(["", "<hr>", "<br>"])

    def menu(kind: str = "menu", n: int | None = None) -> str:
        items = "".join(f'<li><a href="/{k}">{text(r.randint(1, 3), False)}</a></li>' for k in range(n or r.randint(2, 10)))
        tag = r.choice(["nav", "div", "nav", "section"]) if kind == "menu" else r.choice(["div", "section", "aside"])
        head = f"<h3>{text(r.randint(1, 3), False)}</h3>" if kind == "side" and r.random() < 0.6 else ""
        return f"<{tag}{attrs(kind, 0.5 if tag == 'nav' else 0.95)}>{head}<ul>{items}</ul></{tag}>"

    def ad() -> str:
        return f'<div{attrs("ad", 1)}>{r.choice(["", "<p>"])}{text(r.randint(3, 25), False)}</div>'

    def notice() -> str:
        return f'<{(tag := r.choice(["div", "section", "aside"]))}{attrs("notice", 1)}>{para(r.randint(5, 30), False)}{r.choice(["", "<button>OK</button>"])}</{tag}>'

    def form() -> str:
        return f'<form action="/s"{attrs("notice", 0.3)}>{r.choice(["<label>", "<p>"])}{text(r.randint(1, 10), False)}<input name="q"><button>{text(1, False)}</button></form>'

    def comments() -> str:
        tag = r.choice(["div", "section", "ol", "ul"])
        inner = "div" if tag in ("div", "section") else "li"
        rows = "".join(f'<{inner}{attrs("comments", 0.8 if inner == "div" else 0.4)}>{r.choice(["", f"<h4>{text(2, False)}</h4>"])}{"".join(para(r.randint(4, 45), False) for _ in range(r.randint(1, 2)))}</{inner}>' for _ in range(r.randint(1, 5)))
        return f'<{tag}{attrs("comments", 1)}>{r.choice(["", f"<h3>{text(2, False)}</h3>"]) if inner == "div" else ""}{rows}</{tag}>'

    def share() -> str:
        return f'<div{attrs("share", 1)}><a href="#">{text(1, False)}</a> <a href="#">{text(1, False)}</a></div>'

    def prose(n: int) -> str:
        """A paragraph, or some, as this page marks them up."""
        how = r.choice(["p", "div", "section", "span"]) if style == "any" else style
        if how == "p" or r.random() < 0.03:
            if r.random() < 0.02:  # one link and nothing else
                return f'<p><a href="/{n}">{text(max(n, 5), True)}</a></p>'
            return para(n, True)
        if how == "breaks":
            parts = [_words(r, n) for _ in range(r.randint(1, 5))]
            kept.add(" ".join(_html.unescape(" ".join(parts)).split()))
            return f"<div{own_names}>{r.choice(['<br><br>', '<br/>', '<br>'  + chr(10)]).join(parts)}</div>"
        t = text(n, True)
        if how == "span":
            return f"<div{own_names}><span>{t}</span></div>"
        return f"<{how}{own_names if r.random() < 0.8 else odd()}>{t}</{how}>"

    own_names = odd() if r.random() < 0.5 else ""

    def meta() -> str:
        """What stands in an article's own head or foot: who wrote it and when, under what it is filed, where to go next."""
        bits = r.choice([
            lambda: f"{text(1, False)} {text(2, False)}, {r.randint(1, 28)} {text(1, False)} {r.randint(1999, 2030)}",
            lambda: ", ".join(f'<a href="/t{k}">{text(1, False)}</a>' for k in range(r.randint(1, 4))),
            lambda: f'<a href="/n">{text(r.randint(1, 4), False)}</a>',
        ])()
        tag = r.choice(["footer", "footer", "div", "nav"])
        return f"<{tag}{attrs('share', 1) if tag == 'div' else attrs('footer', 0.5)}>{bits}</{tag}>"

    def body() -> str:
        out, bare = [], r.random() < 0.3
        if r.random() < 0.72:
            h = f"<h1>{text(r.randint(2, 12), True)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
        for _ in range(r.choice([1, 1, 2, 3, 3, 5, 8, 14, 25])):
            kind = r.random()
            n = r.choice([1, 2, 5, 12, 18, 30, 60, 120])
            if kind < 0.78:
                out.append(prose(n))
            elif kind < 0.84:
                out.append(f"<h2>{text(r.randint(1, 8), True)}</h2>")
            elif kind < 0.89:
                out.append(f"<{(tag := r.choice(['ul', 'ul', 'ol']))}>{''.join(f'<li>{text(r.randint(2, 20), True)}</li>' for _ in range(r.randint(1, 5)))}</{tag}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{r.choice([para(n, True), text(n, True)])}</blockquote>")
            elif kind < 0.94:
                out.append(f"<table>{''.join(f'<tr><td>{text(2, True)}</td><td>{text(3, True)}</td></tr>' for _ in range(r.randint(1, 4)))}</table>")
            elif kind < 0.96:
                out.append(f'<figure><img src="a.png"><figcaption>{text(r.randint(3, 12), True)}</figcaption></figure>')
            elif bare:
                out.append(f"{text(n, True)}<hr>")
            else:
                out.append(f"<div{odd()}>{text(n, True)}</div>")
            if r.random() < 0.08:
                out.append(r.choice([ad, share, notice, form])())
        if r.random() < 0.12:
            out.append(meta())
        if len(out) > 1 and r.random() < 0.3:  # the heading, then the rest in a box of its own
            out[1:] = [f"<div{attrs('content', 0.8)}>", *out[1:], "</div>"]
        return "".join(out)

    core = body()
    if r.random() < 0.15:
        core += r.choice([comments, share, lambda: menu("side")])()
    how = r.random()
    alone = r.random() < 0.08  # nothing but prose
    if alone:
        core = "".join(prose(r.choice([1, 3, 12, 30, 60])) for _ in range(r.choice([1, 2, 2, 3, 4])))
        if r.random() < 0.5:
            core = f"<div{odd()}>{core}</div>"
    elif how < 0.35:
        core = f"<article{attrs('content', 0.3)}>{core}</article>"
    elif how < 0.55:
        core = f"<div{attrs('content', 1)}>{core}</div>"
    elif how < 0.75:
        core = f"<{(tag := r.choice(['div', 'div', 'section']))}{odd()}>{core}</{tag}>"
    elif how < 0.8:
        core = f"<table><tr><td>{menu('menu', 4) if r.random() < 0.5 else ''}</td><td{odd()}>{core}</td></tr></table>"
    elif how < 0.9:
        core = f"<main{attrs('content', 0.3)}>{core}</main>"
    if r.random() < 0.25 and not alone:
        core = f"<main>{core}</main>" if how < 0.75 else core
    parts_before = [f for f, p in ((lambda: menu("menu"), 0.7), (lambda: f"<header{attrs('header', 0.4)}>{r.choice(['', '<h2>'])}{text(r.randint(1, 6), False)}{r.choice(['', menu('menu', 3)])}</header>", 0.4), (lambda: f"<div{attrs('header', 1)}>{r.choice([lambda: text(r.randint(1, 6), False), stray, stray])()}</div>", 0.35), (ad, 0.4), (notice, 0.25), (form, 0.15), (lambda: menu("side"), 0.15), (stray, 0.2)) if r.random() < p]
    parts_after = [f for f, p in ((comments, 0.3), (lambda: menu("side"), 0.3), (lambda: f"<aside{attrs('side', 0.5)}>{para(r.randint(3, 40), False)}{para(r.randint(3, 20), False)}</aside>", 0.25), (ad, 0.2), (share, 0.15), (form, 0.15), (notice, 0.15), (stray, 0.2)) if r.random() < p]
    if alone:
        parts_before, parts_after = [], []
    r.shuffle(parts_before)
    r.shuffle(parts_after)
    foot = f"<footer{attrs('footer', 0.4)}>&copy; {text(r.randint(1, 25), False)}</footer>" if r.random() < 0.75 else f"<div{attrs('footer', 1)}>{text(r.randint(1, 15), False)}</div>"
    if alone:
        foot = ""
    inside = "".join(f() for f in parts_before) + core + "".join(f() for f in parts_after)
    if r.random() < 0.4:
        inside = f"<div{attrs('plain', 0.9)}>{inside}</div>"
    if r.random() < 0.15 and not alone:
        foot += stray()
    if r.random() < 0.1:
        inside = inside.replace("</div>", "", 1) if r.random() < 0.5 else inside + "</div></section>"
    head = "".join(x for x in (f"<title>{_words(r, r.randint(1, 9))}</title>", "<meta charset=utf-8>", "<style>.a > p { color: #123 }</style>", '<script src="a.js"/></script>', "<script>if (1 < 2) document.write('<p>x</p>')</script>", "<link rel=stylesheet href=a.css>") if r.random() < 0.5)
    begin = r.choice(["<!DOCTYPE html><html>", "<html>", "", "<!doctype html>\n<html lang=en>\n"])
    end = r.choice(["</body></html>", "</body></html>", "</html>", ""])
    return f"{begin}<head>{head}</head><body{attrs('plain', 0.1)}>{inside}{foot}{end}", kept


def extract(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space (a line break tag counts as white
    space), blocks are joined by two line feeds in page order.  A null or empty html, or one without an article, gives an
    empty text.  Repeated rows give equal results; an empty table gives an empty one.
    """
    prepare(pages.sparkSession)
    model = model or fit_extractor()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = model.texts([h or "" for h in part.column(2).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(lean(extracted), "page_id long, url string, text string, n_chars long")
