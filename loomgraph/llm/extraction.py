"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, prepare, quoted

#: An attribute, cut as the standard's tokeniser does: a name, then after "=" a value in
#: quotes or without any. A quote that is never closed is part of a name, so the tag ends
#: at the next ">".
_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTR})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Fixed values of HTML: elements without content, with raw content, that end a paragraph.
# Only elements whose content is no markup are skipped up to their end tag; the content
# of those in SHOWN is text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
SHOWN = frozenset("xmp plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head button label "
    "caption dir legend listing optgroup option plaintext search xmp".split()
)
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Words in class, id and role that speak for one kind of block or the other.
HINTS = (
    "ad ads advert adverts advertisement banner sponsor sponsored promo promoted nav navbar navigation menu header head masthead topbar footer foot bottom copyright "
    "sidebar side aside widget related recommended trending popular notice alert cookie consent gdpr popup modal overlay newsletter subscribe signup login form search "
    "comment comments reply replies discussion disqus respond share social breadcrumb breadcrumbs pagination pager tags meta author byline toolbar "
    "article content main body text post entry story page"
).split()
_HINTS = frozenset(HINTS)


class Block:
    """Text between two block borders, and the elements that it stands in."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def _element(tag: str, attributes: str) -> str:
    """The tag and the known words of its class, id and role, as one string."""
    words: list[str] = []
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "=" in attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            words += re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())
    return " ".join([tag, *(w for w in words if w in _HINTS)])


def leaf_blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order. Every text node is in one, but for scripts, styles,
    titles and the like. What is never closed goes by the standard (a comment or script
    lasts to the end), but an open title or textarea ends at the next tag."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = at = 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(e for t, e in stack if t in BLOCK or " " in e), text, min(len(text), linked)))
            parts.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        parts.append(piece)
        if any(t == "a" or t == "button" for t, _ in stack):
            linked += len(piece)

    foreign = lambda: any(t == "svg" or t == "math" for t, _ in stack)
    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            add(entities.unescape(html[at:]))
            break
        if m.start() > at:
            add(entities.unescape(html[at : m.start()]))
        start, at = m.start(), m.end()
        tag = m[2]
        if tag is None:
            if html.startswith("<![CDATA[", start) and foreign():
                stop = html.find("]]>", start)
                at = stop + 3 if stop >= 0 else end
                add(html[start + 9 : stop if stop >= 0 else end])
            continue
        tag = tag.lower()
        if m[1]:
            if any(t == tag for t, _ in stack):
                if tag in BLOCK:
                    close()
                while stack.pop()[0] != tag:
                    pass
            elif tag == "p":
                close()
        elif tag in RAW:
            if _empty(m[3]) and foreign():
                continue
            stop = _end_of(tag).search(html, at) if tag != "plaintext" else None
            inside = html[at : stop.start() if stop else end]
            if stop is None and tag in ("title", "textarea"):
                rest = _TOKEN.search(html, at)
                at = rest.start() if rest else end
            elif stop is not None or not _empty(m[3]):
                at = stop.end() if stop else end
            if tag in SHOWN:
                close()
                add(inside)
                close()
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                close()
        else:
            if _empty(m[3]) and foreign():
                continue
            if tag in BLOCK:
                close()
                if tag != "p" and stack and tag not in ("body", "html"):
                    _end_paragraph(stack)
                for open_tag in SELF_CLOSING.get(tag, ()):
                    _imply(stack, open_tag, tag)
            stack.append((tag, _element(tag, m[3])))
    close()
    return out


@lru_cache(maxsize=None)  # one for each name in RAW
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I)


def _empty(attributes: str) -> bool:
    """Whether the tag ends in "/>", the slash being no part of a value without quotes."""
    return attributes.endswith("/") and not re.search(r"""=\s*[^\s"'>][^\s>]*/$""", attributes)


def _end_paragraph(stack):
    """A block element ends an open paragraph."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            del stack[k:]
            return
        if stack[k][0] in BLOCK:
            return


def _imply(stack, open_tag, tag):
    """The start of an element ends an open one of its kind in the same list or table."""
    for k in range(len(stack) - 1, -1, -1):
        t = stack[k][0]
        if t == open_tag:
            del stack[k:]
            return
        if t in ("ul", "ol", "dl", "menu", "table", "tbody", "thead", "tfoot", "article", "section", "div", "main", "body") or (t == "tr" and tag in ("td", "th")):
            return


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found = {"bias"}
    for e in path:
        tag, *hints = e.split(" ")
        found.add(f"in:{tag}")
        found.update(f"hint:{h}" for h in hints)
    if path:
        found.add(f"last:{path[-1].split(' ')[0]}")
    if not any(e.split(" ")[0] in ("article", "main") for e in path):
        found.add("no-article")
    # The innermost element that tells anything.
    for e in reversed(path):
        tag, *hints = e.split(" ")
        if hints or tag in ("article", "main", "nav", "header", "footer", "aside", "form", "label", "button"):
            found.update(f"inner:{h}" for h in (hints or [tag]))
            break
    return tuple(sorted(found))


def _text_features(b: Block) -> tuple[str, ...]:
    n, t = len(b.text), b.text
    words = t.count(" ") + 1
    return (
        f"length:{min(6, int(np.log2(n + 1)) // 2)}" if n > 1 else "length:0",
        f"linked:{3 * b.linked // n}",
        "many-words" if words > 12 else "few-words",
        "ends" if t[-1] in ".!?\"'”»…:" else "no-end",
        "copyright" if "©" in t else "plain",
    )


class BlockCRF:
    """Labels 0 (boilerplate) and 1 (main text), with transitions between neighbours."""

    def __init__(self):
        self.weights: dict[str, list[float]] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self._paths: dict[tuple[str, ...], tuple[float, float]] = {}

    def fit(self, pages, rounds: int = 45, rate: float = 0.2, ridge: float = 1e-3) -> BlockCRF:
        """pages: lists of (block, label). Maximises the conditional likelihood by Adam
        on whole batches; expectations come from forward and backward sums."""
        names: dict[str, int] = {}
        data = []
        for page in pages:
            rows = [[names.setdefault(f, len(names)) for f in (*_path_features(b.path), *_text_features(b))] for b, _ in page]
            if rows:
                data.append((rows, np.array([l for _, l in page])))
        w, move = np.zeros((len(names), 2)), np.zeros((2, 2))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
        for step in range(1, rounds + 1):
            gw, gm = -ridge * len(data) * w, -ridge * len(data) * move
            for rows, labels in data:
                score = np.array([w[r].sum(axis=0) for r in rows])
                fore, back = np.zeros_like(score), np.zeros_like(score)
                fore[0] = score[0]
                for t in range(1, len(rows)):
                    fore[t] = score[t] + np.logaddexp(fore[t - 1, 0] + move[0], fore[t - 1, 1] + move[1])
                for t in range(len(rows) - 2, -1, -1):
                    after = score[t + 1] + back[t + 1]
                    back[t] = np.logaddexp(move[:, 0] + after[0], move[:, 1] + after[1])
                whole = np.logaddexp(fore[-1, 0], fore[-1, 1])
                belief = np.exp(fore + back - whole)
                for t, r in enumerate(rows):
                    gw[r] -= belief[t]
                    gw[r, labels[t]] += 1
                for t in range(1, len(rows)):
                    gm -= np.exp(fore[t - 1][:, None] + move + (score[t] + back[t])[None, :] - whole)
                    gm[labels[t - 1], labels[t]] += 1
            for k, (value, g) in enumerate(((w, gw), (move, gm))):
                g = g / len(data)
                m, v = moments[2 * k], moments[2 * k + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = {f: w[i].tolist() for f, i in names.items()}
        self.move = move.tolist()
        return self

    def _score(self, b: Block) -> tuple[float, float]:
        base = self._paths.get(b.path)
        if base is None:
            found = [self.weights[f] for f in _path_features(b.path) if f in self.weights]
            base = (sum(f[0] for f in found), sum(f[1] for f in found))
            if len(self._paths) < 50_000:
                self._paths[b.path] = base
        x, y = base
        for f in _text_features(b):
            if f in self.weights:
                p, q = self.weights[f]
                x += p
                y += q
        return x, y

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        (a, b), (c, d) = self.move
        x, y = self._score(blocks[0])
        from_where = []
        for block in blocks[1:]:
            p, q = self._score(block)
            from_where.append((int(y + c > x + a), int(y + d > x + b)))
            x, y = p + max(x + a, y + c), q + max(x + b, y + d)
        label = int(y > x)
        out = [label]
        for step in reversed(from_where):
            label = step[label]
            out.append(label)
        return out[::-1]


def labelled_pages(n: int = 160, seed: int = 3) -> list[list[tuple[Block, int]]]:
    """Pages put together from parts of known kind, for training: each is a list of
    (block, label). Their layouts differ in which containers they use and how they name them."""
    rng = random.Random(seed)
    syllables = "ta re mi no la ve su ko da li en or is ha tu".split()

    def words(a, b):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a, b):
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(tag="li"):
        return "".join(f'<{tag}><a href="/x">{words(1, 2)}</a></{tag}>' for _ in range(rng.randint(2, 8)))

    mark = "\ue000"  # opens main text; the block's label is read off it

    def boiler(cell=False):
        kind = rng.choice(["nav", "ad", "footer", "header", "aside", "comments", "form", "notice", "related"])
        few = sentence(2, 14)
        name = {
            "nav": ["menu", "navbar", "nav", "breadcrumb"],
            "ad": ["ad", "ads", "advert", "banner", "sponsored", "promo"],
            "footer": ["footer", "bottom", "copyright"],
            "header": ["header", "masthead", "topbar"],
            "aside": ["sidebar", "side", "widget"],
            "comments": ["comments", "comment", "discussion", "replies"],
            "form": ["form", "newsletter", "subscribe", "search", "login"],
            "notice": ["notice", "cookie", "consent", "alert", "popup"],
            "related": ["related", "recommended", "popular", "trending", "share", "social"],
        }[kind]
        attribute = f'{rng.choice(["class", "id"])}="{rng.choice(name)}"'
        body = {
            "nav": f"<ul>{links()}</ul>",
            "ad": few,
            "footer": f"&copy; {words(1, 2)} &middot; {few}",
            "header": f"<h1>{words(1, 3)}</h1><p>{few}</p>",
            "aside": f"<h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{few}</p>",
            "comments": "".join(f"<{rng.choice(['p', 'div', 'li'])}>{sentence(3, 40)}" for _ in range(rng.randint(1, 4))),
            "form": f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button><p>{few}</p>",
            "notice": f"<p>{few}</p><button>{words(1, 1)}</button>",
            "related": f"<ul>{links()}</ul>",
        }[kind]
        if cell:
            return f"<td {attribute}>{body}</td>"
        own = {"nav": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form"}.get(kind)
        if own and rng.random() < 0.6:
            return f"<{own}{' ' + attribute if rng.random() < 0.3 else ''}>{body}</{own}>"
        box = rng.choice(["div", "section", "div"])
        return f"<{box} {attribute}>{body}</{box}>"

    def main_text_piece():
        text = sentence(1, 3) if rng.random() < 0.15 else sentence(4, 60)
        body = f"<b>{text}<br>" if rng.random() < 0.2 else text
        if rng.random() < 0.15:
            body += f' <a href="/y">{words(1, 3)}</a> {words(0, 4)}'
        return mark + body

    def main_part():
        kind = rng.choice(["p"] * 8 + ["h2", "h3", "blockquote", "pre", "li", "list", "list", "links", "table", "section", "div", "figure"])
        many = lambda tag: "".join(f"<{tag}>{main_text_piece()}" + (f"</{tag}>" if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 5)))
        if kind == "list":
            box = rng.choice(["ul", "ol"])
            return f"<{box}>{many('li')}</{box}>"
        if kind == "links":  # a list of links that is part of the text
            box, tail = rng.choice(["ul", "ol"]), rng.random() < 0.3
            return f"<{box}>" + "".join(f'<li><a href="/z">{mark}{words(1, 7)}</a>{" " + words(1, 6) if tail else ""}</li>' for _ in range(rng.randint(2, 8))) + f"</{box}>"
        if kind == "table":
            return f"<table>{''.join(f'<tr>{many("td")}</tr>' for _ in range(rng.randint(1, 3)))}</table>"
        if kind == "section":
            return f"<section><h3>{mark}{words(1, 5)}</h3>{many('p')}</section>"
        if kind == "div":
            return f"<div>{many('p')}</div>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{main_text_piece()}</figcaption></figure>"
        return f"<{kind}>{main_text_piece()}" + (f"</{kind}>" if kind != "p" or rng.random() < 0.8 else "")

    pages = []
    for _ in range(n):
        title = f"<h1>{mark}{words(2, 10).capitalize()}</h1>" if rng.random() < 0.9 else ""
        parts = [main_part() for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), boiler())
        opening, closing = rng.choice(
            [("<article>", "</article>")] * 3 + [("", ""), ('<div role="main">', "</div>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="post entry">', "</div>")]
        )
        before = "".join(boiler() for _ in range(rng.randint(0, 4)))
        after = "".join(boiler() for _ in range(rng.randint(0, 4)))
        body = f"{opening}{title}{''.join(parts)}{closing}"
        if rng.random() < 0.1:  # columns made by a table
            body = f"<table><tr>{boiler(True)}<td{rng.choice(['', ' class=content', ' id=main'])}>{body}</td>{boiler(True) if rng.random() < 0.5 else ''}</tr></table>"
        page = f"<html><head><title>{words(2, 5)}</title></head><body>{before}{body}{after}</body></html>"
        blocks = []
        for b in leaf_blocks(page):
            label = int(mark in b.text)
            b.text = b.text.replace(mark, "").strip()
            b.linked = min(b.linked, len(b.text))
            if b.text:
                blocks.append((b, label))
        pages.append(blocks)
    return pages


@lru_cache(maxsize=1)
def trained() -> BlockCRF:
    return BlockCRF().fit(labelled_pages())


def main_text(html: str | None, crf: BlockCRF) -> str:
    if not html:
        return ""
    blocks = leaf_blocks(html)
    return "\n\n".join(b.text for b, label in zip(blocks, crf.decode(blocks)) if label)


def extract(pages: DataFrame, html: str = "html", crf: BlockCRF | None = None) -> DataFrame:
    """pages without the html column, with text (main text, empty if none) and n_chars.

    The whole page is parsed into leaf blocks; character references are decoded, white
    space inside a block becomes one blank; blocks that the field labels as main text
    are joined by two line feeds in page order. Null and empty pages give empty text; ties
    between labelings go to boilerplate; a page of any length is parsed whole, in time that
    grows with its length. One narrow pass; repeated rows give equal results, an empty
    table an empty one; columns named text and n_chars give way."""
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(crf or trained())  # a weight for each feature
    keep = [c for c in carried(pages, ["text", "n_chars"]) if c != html]
    kinds = dict(pages.dtypes)

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(len(keep))]
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])
    return pages.select(*[quoted(c) for c in keep], quoted(html)).mapInArrow(run, schema)
