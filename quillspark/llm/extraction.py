"""Main-text extraction from HTML.

Each DOM element gets features of its tag, attribute tokens, depth, subtree density and siblings; gradient-boosted
trees give its log-odds of being main text. Hierarchical decoding then labels the whole tree at once: an element is
a container, main text or boilerplate; below boilerplate all is boilerplate and below main text nothing is a mere
container, so no ancestor contradicts a descendant; dynamic programming finds the best labelling. The trees are
fitted here, on pages composed from many layouts with known labels (`sample_pages`), the same at every size.

Edge cases: null, empty and tagless html give the text that is there, or an empty text; a null id stays null;
repeated rows are read one by one; pages of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import row_groups, string_column, text_buffer, tidily
from .dom import Node, attributes, parse

#: Attribute tokens by meaning (fixed values).
TOKENS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar submenu skip",
    "head": "header masthead banner logo branding top hero",
    "foot": "footer foot copyright bottom legal colophon imprint",
    "side": "sidebar aside side rail widget widgets secondary complementary related recommended recommendations trending popular more similar teaser tags tag archive",
    "advert": "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner dfp taboola outbrain commercial",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast newsletter paywall privacy announcement dialog",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader feedback responses reviews review",
    "form": "form search searchform login signin signup subscribe subscription register newsletter input contact poll survey",
    "share": "share sharing social follow facebook twitter buttons toolbar tools actions rating byline meta author print",
    "body": "article content post entry story main body text prose maincontent articlebody postbody entrycontent storybody richtext copy page document",
}
_GROUP = {t: g for g, names in enumerate(TOKENS.values()) for t in names.split()}
_GROUPS = len(TOKENS)
_TAGS = ("p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul", "ol", "li", "a", "table", "td", "blockquote", "pre", "figure", "figcaption", "h1", "h2", "h3", "span", "button", "label", "select", "dialog", "iframe", "script", "style", "noscript", "title", "head")
_TAG_CODE = {t: i + 1 for i, t in enumerate(_TAGS)}
_BAD_TAG = {"nav": 0, "aside": 1, "footer": 2, "header": 3, "form": 4, "dialog": 5, "menu": 0, "select": 4, "button": 4}
_NEVER = frozenset("script style noscript template head title iframe svg math object textarea select button input option".split())
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_INLINE = frozenset("b i em strong span a u s small sub sup code mark q cite abbr time font tt kbd var samp big del ins dfn label bdi bdo".split())
_PUNCTUATION = re.compile(r"[.!?;:,]")
N_FEATURES = 27 + 2 * _GROUPS
_SHIFTS = np.arange(_GROUPS)


def tokens(raw: str) -> int:
    """The meanings of an element's class, id and role, as bits."""
    if not raw or "=" not in raw:
        return 0
    attrs, bits = attributes(raw), 0
    for name in ("class", "id", "role", "itemprop", "aria-label"):
        value = attrs.get(name)
        if value:
            for t in (*_SPLIT.findall(value), *re.split(r"[\s_-]+", value.lower()), value.lower().replace("-", "").replace("_", "")):
                g = _GROUP.get(t.lower())
                if g is not None:
                    bits |= 1 << g
    return bits


def describe(nodes: list[Node]) -> np.ndarray:
    """Features of all elements of a page."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [-1] * n
    depth, bits, above, bad, good = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own_text, text, links, words, tags, marks, paragraphs, blocks = ([0] * n for _ in range(8))
    for i, x in enumerate(nodes):
        if i:
            p = parent[i] = place[id(x.parent)]
            depth[i] = depth[p] + 1
            bits[i] = tokens(x.attrs)
            above[i] = above[p] | bits[p]
            bad[i] = bad[p] | (1 << _BAD_TAG[x.tag] if x.tag in _BAD_TAG else 0)
            good[i] = good[p] | (1 if x.tag == "article" else 2 if x.tag == "main" else 0)
        if x.parts and x.tag not in _NEVER:
            s = " ".join(t for _, t in x.parts if t)
            w = s.split()
            own_text[i] = text[i] = sum(map(len, w))
            words[i] = len(w)
            marks[i] = len(_PUNCTUATION.findall(s))
        blocks[i] = int(text[i] > 0)
    for i in range(n - 1, 0, -1):
        p, x = parent[i], nodes[i]
        tags[i] += 1
        if x.tag == "a":
            links[i] = text[i]
        paragraphs[i] += x.tag == "p" and text[i] > 0
        for column in (text, links, words, tags, marks, paragraphs, blocks):
            column[p] += column[i]
    count, same = [1] * n, [1] * n
    for x in nodes:
        if x.children:
            names: dict[str, int] = {}
            for c in x.children:
                names[c.tag] = names.get(c.tag, 0) + 1
            for c in x.children:
                i = place[id(c)]
                count[i], same[i] = len(x.children), names[c.tag]
    up = np.maximum(np.array(parent), 0)
    t, own, w, k, b, a, bad_, good_ = (np.array(c) for c in (text, own_text, words, tags, bits, above, bad, good))
    link, mark, para, block, many, like, deep = (np.array(c) for c in (links, marks, paragraphs, blocks, count, same, depth))
    total, t1 = max(1, text[0]), np.maximum(t, 1)
    share = link / t1
    out = np.empty((n, N_FEATURES))
    columns = (
        [_TAG_CODE.get(x.tag, 0) for x in nodes], [x.tag in _INLINE for x in nodes], deep, np.log1p(t), t / total, share, t / (k + 1), mark / np.maximum(w, 1), w / np.maximum(block, 1),
        para, np.log1p(own), (np.cumsum(own) - own) / total, t / t1[up], many, like / many, t[up] / many, share[up], para[up],
        bad_ & 1 > 0, bad_ & 2 > 0, bad_ & 4 > 0, bad_ & 8 > 0, bad_ & 16 > 0, bad_ & 32 > 0, good_ & 1, good_ & 2 > 0, np.log1p(k),
    )
    for j, c in enumerate(columns):
        out[:, j] = c
    out[:, 27 : 27 + _GROUPS] = b[:, None] >> _SHIFTS & 1
    out[:, 27 + _GROUPS :] = a[:, None] >> _SHIFTS & 1
    return out


def decode(nodes: list[Node], log_odds: np.ndarray, switch: float = 1.0) -> list[bool]:
    """For each element, whether its own text is main text, by the best labelling of the tree."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    odds = np.clip(log_odds, -8, 8)
    yes, no = (-np.log1p(np.exp(-odds))).tolist(), (-np.log1p(np.exp(odds))).tolist()
    sums = [[0.0, 0.0, 0.0] for _ in range(n)]  # of the children: below a container, main text, boilerplate
    free, main, rest = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        has = any(t and not t.isspace() for _, t in x.parts)
        never = x.tag in _NEVER
        weight = 3.0 if has else 1.0
        free[i] = sums[i][0] + (no[i] * weight if has else -0.35)
        main[i] = -1e9 if never else sums[i][1] + weight * yes[i]
        rest[i] = sums[i][2] + (0.0 if never else weight * no[i])
        if i:
            p = place[id(x.parent)]
            sums[p][0] += max(free[i], main[i] - 0.2 * switch, rest[i])
            sums[p][1] += max(main[i], rest[i] - switch)
            sums[p][2] += rest[i]
    state = [0] * n
    for i, x in enumerate(nodes):
        if i == 0:
            options = [(free[0], 0), (main[0], 1), (rest[0], 2)]
        else:
            above = state[place[id(x.parent)]]
            options = [(free[i], 0), (main[i] - 0.2 * switch, 1), (rest[i], 2)] if above == 0 else [(main[i], 1), (rest[i] - switch, 2)] if above == 1 else [(rest[i], 2)]
        state[i] = max(options, key=lambda o: o[0])[1]
    return [s == 1 for s in state]


def outside_boilerplate(nodes: list[Node]) -> list[bool]:
    """For each element, whether neither it nor an ancestor names boilerplate by its tag or its attribute tokens."""
    place = {id(x): i for i, x in enumerate(nodes)}
    body = 1 << list(TOKENS).index("body")
    out: list[bool] = []
    for x in nodes:
        own = x.tag not in _BAD_TAG and x.tag not in _NEVER and not tokens(x.attrs) & ~body
        out.append(own and (x.parent is None or out[place[id(x.parent)]]))
    return out


def assemble(nodes: list[Node], chosen: list[bool]) -> str:
    """The chosen elements' text in page order: one space between blocks and for white space within them."""
    parts = [p for x, c in zip(nodes, chosen, strict=True) if c for p in x.parts]
    parts.sort()
    return " ".join("".join(t or " " for _, t in parts).split())


# --- pages to learn from --------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ten ra su vel dor in es tal or ne pha gu ber ash cle tor an".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _prose(r: random.Random, sentences: int, links: float = 0.12) -> str:
    out = []
    for _ in range(sentences):
        s = _words(r, r.randint(1, 18)).capitalize()
        if r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        for tag, chance, most in ((r.choice(["b", "i", "em", "strong", "span", "code"]), 0.13, 3), ('a href="/x"', links, 9)):
            if r.random() < chance:
                at = s.split(" ")
                k = r.randrange(len(at))
                n = r.randint(1, most)
                at[k : k + n] = [f"<{tag}>{' '.join(at[k : k + n])}</{tag.split()[0]}>"]
                s = " ".join(at)
        out.append(s + r.choice(["...", ".", ".", ".", "?", "!"]))
    return " ".join(out)


def _named(r: random.Random, group: str, tag: str = "div") -> tuple[str, str]:
    name = r.choice(TOKENS[group].split())
    if r.random() < 0.5:
        name = r.choice([name, f"{name}-{r.choice(['box', 'wrap', 'area', 'block', 'list', 'inner', 'container'])}", f"site-{name}", f"{name}_{r.randint(1, 9)}"])
    return f'<{tag} {r.choice(["class", "class", "id", "role"])}="{name}">', f"</{tag}>"


def _boiler(r: random.Random) -> str:
    kind = r.choice(["nav", "head", "foot", "side", "advert", "notice", "comment", "form", "share", "nav", "foot", "comment"])
    native = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}
    if kind in native and r.random() < 0.55:
        a, b = (f"<{native[kind]}>", f"</{native[kind]}>") if r.random() < 0.7 else _named(r, kind, native[kind])
    else:
        a, b = _named(r, kind, r.choice(["div", "div", "section", "ul" if kind == "nav" else "div", "aside" if kind in ("side", "advert") else "div"]))
    link = lambda: f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a>'
    if kind in ("nav", "share"):
        inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(2, 8)))
        inner = inner if a.startswith("<ul") or r.random() < 0.3 else f"<ul>{inner}</ul>"
    elif kind in ("foot", "head"):
        inner = r.choice([f"&copy; {_words(r, 2)} &middot; {_prose(r, r.randint(1, 2))}", f"<p>{_prose(r, r.randint(1, 3))}</p>", f"<p>{link()} {link()}</p><p>{_words(r, 5)}</p>", f"<span>{_words(r, 3)}</span>{link()}", f"{_prose(r, 1)}<br>{_prose(r, 1)}"])
    elif kind == "side":
        inner = f"<h3>{_words(r, 2)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>", f"<p>{_prose(r, r.randint(1, 4))}</p>", "".join(f"<div>{link()}<p>{_prose(r, 1)}</p></div>" for _ in range(3))])
    elif kind in ("advert", "notice"):
        inner = r.choice([_prose(r, r.randint(1, 3)), f"<p>{_prose(r, r.randint(1, 4))}</p>", f"<p>{_prose(r, 1)}</p><button>{_words(r, 1)}</button>", f"<span>{_words(r, 4)}</span> {link()}"])
    elif kind == "comment":
        inner = f"<h3>{_words(r, 2)}</h3>" + "".join(r.choice([f"<div class=comment><b>{_words(r, 1)}</b><p>{_prose(r, r.randint(1, 5))}</p></div>", f"<li><p>{_prose(r, r.randint(1, 4))}</p></li>", f"<p>{_prose(r, r.randint(1, 4))}</p>"]) for _ in range(r.randint(1, 6)))
    else:
        inner = f"<label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button>" + r.choice(["", f"<p>{_prose(r, 1)}</p>", f"<select><option>{_words(r, 1)}<option>{_words(r, 1)}</select>"])
    return f"{a}{inner}{b}".replace(">", " data-l=b>", 1)


def _article(r: random.Random) -> str:
    style = r.random()
    if style < 0.5:
        a, b = ("<article>", "</article>") if r.random() < 0.7 else _named(r, "body", "article")
    elif style < 0.65:
        a, b = "<main>", "</main>"
    elif style < 0.9:
        a, b = _named(r, "body", r.choice(["div", "div", "section"]))
    else:
        a, b = r.choice(["<div>", f'<div class="{_words(r, 1)}-{r.randint(1, 99)}">', "<td>"]), "</div>"
        b = "</td>" if a == "<td>" else b
    parts = [f"<h1>{_words(r, r.randint(1, 12))}</h1>"] if r.random() < 0.8 else []
    if r.random() < 0.15:
        parts = [f"<header>{''.join(parts) or '<h1>' + _words(r, 4) + '</h1>'}</header>"]
    links = r.choice([0.0, 0.05, 0.15, 0.4, 0.8])
    for _ in range(r.choice([1, 1, 2, 3, 3, 4, 6, 9, 14])):
        kind = r.random()
        close = "" if r.random() < 0.1 else "</p>"
        if kind < 0.72:
            parts.append(f"<p>{_prose(r, r.choice([1, 1, 2, 4, 7]), links)}{close}")
        elif kind < 0.77:
            parts.append(f"<p><b>{_prose(r, 2)}<br>")
        elif kind < 0.82:
            parts.append(f"<h2>{_words(r, r.randint(1, 6))}</h2>")
        elif kind < 0.87:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 1, links)}" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{_prose(r, 2)}</p></blockquote>")
        elif kind < 0.92:
            parts.append(f"<pre>{_words(r, 12)}\n{_words(r, 5)}</pre>")
        elif kind < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1)}<td>{_words(r, 2)}" for _ in range(3)) + "</table>")
        elif kind < 0.96:
            parts.append(f"<figure><img src=x><figcaption>{_prose(r, 1)}</figcaption></figure>")
        else:
            parts.append(f"<div>{_prose(r, 3, links)}</div>")
    if r.random() < 0.35:
        for _ in range(r.randint(1, 2)):
            parts.insert(r.randint(1, len(parts)), _boiler(r))
    inner = "".join(parts)
    if r.random() < 0.2:
        inner = f"<div>{inner}</div>"
    return a.replace(">", " data-l=c>", 1) + inner + b


def sample_pages(count: int = 600, seed: int = 11) -> list[str]:
    """Pages of many layouts; data-l marks main text (c) and boilerplate (b)."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        if r.random() < 0.08:  # nothing but paragraphs, some of a few words
            out.append("<html><body data-l=c>" + "".join(f"<p>{r.choice([_words(r, r.randint(1, 4)), _prose(r, r.randint(1, 4))])}" for _ in range(r.randint(1, 6))))
            continue
        before = [_boiler(r) for _ in range(r.randint(0, 4))]
        after = [_boiler(r) for _ in range(r.randint(0, 4))]
        body = "".join(before) + _article(r) + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = r.choice(["<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page">{}</div>', "<section>{}</section>", '<div class="container layout">{}</div>']).format(body)
        out.append(f"<html><head><title>{_words(r, 4)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>{body}</body></html>")
    return out


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the elements within main text or boilerplate."""
    xs, ys, ws = [], [], []
    for html in pages:
        nodes, _ = parse(html)
        place = {id(x): i for i, x in enumerate(nodes)}
        label = [-1] * len(nodes)
        for i, x in enumerate(nodes):
            own = attributes(x.attrs).get("data-l") if "data-l" in x.attrs else None
            label[i] = {"c": 1, "b": 0}[own] if own else label[place[id(x.parent)]] if i else -1
        known = [i for i, v in enumerate(label) if v >= 0 and nodes[i].tag not in _NEVER]
        xs.append(describe(nodes)[known])
        ys += [label[i] for i in known]
        ws += [1.0 + (any(t for _, t in nodes[i].parts)) for i in known]
    return np.concatenate(xs), np.array(ys, float), np.array(ws)


_model: boosting.Trees | None = None


def model() -> boosting.Trees:
    """The fitted trees, made once a process."""
    global _model
    if _model is None:
        _model = boosting.fit(*training_rows(sample_pages()))
    return _model


def extract_pages(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page; where the best labelling has none, the text that nothing marks as boilerplate."""
    parsed = [parse(h)[0] for h in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([describe(nodes) for nodes in parsed]))
    out: list[str] = []
    at = 0
    for nodes in parsed:
        text = assemble(nodes, decode(nodes, odds[at : at + len(nodes)]))
        out.append(text or assemble(nodes, outside_boilerplate(nodes)))
        at += len(nodes)
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, main text and its code points."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    want = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        trees = shared.value
        for batch in batches:
            raw, off = text_buffer(string_column(batch, "html"))
            for lo, hi in row_groups(off, 1 << 20):
                data, at = raw[off[lo] : off[hi]].tobytes(), (off[lo : hi + 1] - off[lo]).tolist()
                texts = extract_pages([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], trees)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return want.mapInArrow(tidily(run), "page_id bigint, url string, text string, n_chars bigint")
