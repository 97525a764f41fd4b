"""Markup residue in texts: HTML, Markdown, wiki and LaTeX become clean text that keeps headings, list items, code
blocks and formulas apart.

A text is read into blocks in document order, each with its kind, visible text and place in the document tree. What the
markup itself never shows (comments, style sheets, templates, preambles, references) is no content by definition. Which
of the visible blocks are content and which are boilerplate (menus, link lists, footers, notices) is one minimum-cut
labelling per document: a logistic classifier of link share, wording and place in the document, which does not see the
kind of a block, gives the terminal capacities; neighbouring blocks and blocks with the same parent are joined by
smoothness edges, so a doubtful block goes with those around it. A block whose own preference outweighs all its edges
keeps it (this never changes the minimum cut), so max-flow runs on the rest, one connected stretch at a time.

Defined cases: null texts give nothing, empty and blank texts an empty clean text; texts without markup are paragraphs
and lose only stray inline markup; very long texts are used whole; repeated rows count once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import spread

PARTS = ("heading", "listitem", "code", "formula")
HIDDEN = ("comment", "style", "template", "preamble", "reference")


class Block:
    __slots__ = ("chrome", "kind", "level", "links", "parent", "text")

    def __init__(self, kind: str, text: str, parent: int = 0, level: int = 0, links: int = 0, chrome: bool = False):
        self.kind, self.text, self.parent, self.level, self.links, self.chrome = kind, text, parent, level, links, chrome


def plain(s: str) -> str:
    return " ".join(s.split())


# --- which markup ---------------------------------------------------------------------------------------------

HTML_MARK = re.compile(r"</?(?:p|h[1-6]|ul|ol|div|table|li|body|html|pre)\b[^>]*>", re.I)
TEX_MARK = re.compile(r"\\begin\{\w+\*?\}|\\(?:sub)*section\*?\{|\\documentclass|\\item\b")
WIKI_MARK = re.compile(r"(?m)^={2,6}[^=\n].*[^=\n]={2,6}[ \t]*$|<syntaxhighlight|<math>|\[\[[^\]\n]+\|[^\]\n]+\]\]|\{\{[^{}\n]+\}\}|<ref[ >]|\[https?://\S+ [^\]\n]+\]|'''")
MD_MARK = re.compile(r"(?m)^#{1,6} |^(?:```|~~~)|^(?:={3,}|-{3,})[ \t]*$|\]\([^)\s]+\)|^\$\$|^ {0,3}(?:[-*+]|\d+[.)]) |^> ")


def dialect(text: str) -> str:
    h = len(HTML_MARK.findall(text))
    t = len(TEX_MARK.findall(text))
    w = len(WIKI_MARK.findall(text))
    m = len(MD_MARK.findall(text))
    if h >= 2 and not re.search(r"(?m)^(?:```|~~~)", text) and (h >= max(t, w) or re.search(r"(?i)<(?:p|h[1-6]|body)\b", text)):
        return "html"
    if t >= 1 and t * 2 >= m and t >= w:
        return "latex"
    if w >= 2 and w >= m - len(re.findall(r"(?m)^(?:#{1,6}|\*+) ", text)) and re.search(r"(?m)^={2,6}|<(?:syntaxhighlight|math|pre)\b|\[\[[^\]\n]*\|", text):
        return "wiki"
    if not m and h < 2 and re.search(r"(?m)^(={2,6})[^=\n]+\1[ \t]*$", text) and re.search(r"''[^'\n]+''", text):
        return "wiki"
    return "markdown" if m else "plain"


# --- HTML -----------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![A-Za-z](?:[^>]*)>|<\?[^>]*>|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.S)
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
BREAKS = {"p", "div", "ul", "ol", "table", "tr", "td", "th", "section", "article", "body", "html", "header", "footer", "nav", "aside", "main", "blockquote", "dl", "dt", "dd", "figure", "figcaption", "form", "hr", "head", "title"}
MATH = re.compile(r"\\\[(.*)\\\]|\\\((.*)\\\)|\$\$(.*)\$\$|\$(.*)\$", re.S)


def math_body(s: str) -> str:
    m = MATH.fullmatch(s.strip())
    return next(g for g in m.groups() if g is not None) if m else s


def read_html(text: str) -> list[Block]:
    out: list[Block] = []
    buf: list[str] = []
    state = {"kind": "text", "level": 0, "links": 0}
    chrome, head, items, link, parent = 0, 0, 0, 0, 0
    lists: list[int] = []  # the parents of items: the open lists

    def flush(kind="text", level=0):
        nonlocal buf
        s = plain(html.unescape("".join(buf)))
        if s:
            out.append(Block("preamble" if head else state["kind"], s, lists[-1] if lists else parent, state["level"], state["links"], chrome > 0))
        buf = []
        state.update(kind=kind, level=level, links=0)

    at, skip, start = 0, "", 0
    formula: tuple[str, int, int] | None = None  # element, depth, where the buffer stood
    for m in TOKEN.finditer(text):
        tok = m.group()
        if skip:  # inside an element whose text is taken as it stands
            t = TAG.match(tok)
            if tok[1] != "/" or not t or t[1].lower() != skip:
                continue
            body = text[start : m.start()]
            if skip == "pre":
                out.append(Block("code", html.unescape(re.sub(r"</?(?:code|span|b|i|em|a|kbd|samp|br)\b[^>]*>", "", body, flags=re.I)), parent))
            else:
                out.append(Block("style", body, parent))
            skip, at = "", m.end()
            continue
        piece = text[at : m.start()]
        if piece:
            buf.append(piece)
            if link:
                state["links"] += len(piece)
        at = m.end()
        if tok.startswith("<!--"):
            out.append(Block("comment", tok[4:].removesuffix("-->"), parent))
            continue
        t = TAG.match(tok)
        if not t:
            continue
        name, closing = t[1].lower(), tok[1] == "/"
        if formula:
            if name == formula[0]:
                depth = formula[1] + (-1 if closing else 1)
                formula = (name, depth, formula[2])
                if depth == 0:
                    body = math_body(html.unescape("".join(buf[formula[2] :])))
                    out.append(Block("formula", body, parent))
                    alone = name == "div"
                    buf[formula[2] :] = [] if alone else [html.escape(body, quote=False)]
                    formula = None
            continue
        if not closing and name in ("span", "div") and re.search(r"""class\s*=\s*["']?[^"'>]*\b(?:math|equation|formula|tex)\b""", tok, re.I):
            if name == "div":
                flush()
            formula = (name, 1, len(buf))
        elif name in ("style", "script", "pre", "textarea") and not closing:
            flush(state["kind"] if items else "text", state["level"])
            skip, start = name, m.end()
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            flush() if closing else flush("heading", int(name[1]))
        elif name == "li":
            flush() if closing else flush("listitem", items)
        elif name in ("ul", "ol"):
            flush()
            items = max(0, items + (-1 if closing else 1))
            parent += 1
            if closing:
                del lists[-1:]
            else:
                lists.append(parent)
        elif name == "br":
            buf.append(" ")
        elif name == "a":
            link = 0 if closing else 1
        elif name in BREAKS:
            if name in ("nav", "footer", "aside"):
                flush()
                chrome = max(0, chrome + (-1 if closing else 1))
                parent += 1
            elif name in ("head", "body"):
                flush()
                head = int(name == "head" and not closing)
            elif state["kind"] == "listitem" and items:
                buf.append(" ")  # a paragraph within an item
            else:
                flush()
                parent += 1
        elif name in ("td", "th"):
            buf.append(" ")
    if skip:
        out.append(Block("code" if skip == "pre" else "style", html.unescape(text[start:]), parent))
    else:
        buf.append(text[at:])
    flush()
    return out


# --- LaTeX ----------------------------------------------------------------------------------------------------

TEX_ENV = re.compile(
    r"\\begin\{(?P<code>verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]]*\])?(?P<cb>.*?)\\end\{(?P=code)\}"
    r"|\\begin\{(?P<eq>equation\*?|align\*?|displaymath|gather\*?|eqnarray\*?|multline\*?)\}(?P<eb>.*?)\\end\{(?P=eq)\}"
    r"|\\\[(?P<db>.*?)\\\]|\$\$(?P<dd>.*?)\$\$|\\\((?P<ib>.*?)\\\)|(?<!\\)\$(?P<id>(?=\S)[^$\n]*?[^\s\\$])\$(?!\d)"
    r"|(?<!\\)%(?P<comment>[^\n]*)|\\(?P<sec>(?:sub)*section|chapter|part|paragraph|title)\*?\{|\\(?P<item>item)\b(?:\[[^\]]*\])?[ \t]*|\\(?P<edge>begin|end)\{(?P<env>[^}]*)\}(?:\[[^\]]*\])?|(?P<gap>\n[ \t]*\n\s*)",
    re.S,
)
TEX_DROP = re.compile(r"[~ ]?\\(?:cite[pt]?|footnote|footcite)\*?(?:\[[^\]]*\])*\{[^{}]*\}|\\(?:label|ref|eqref|index|vspace|hspace|pageref)\*?\{[^{}]*\}")
TEX_LINK = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
TEX_WRAP = re.compile(r"\\(?:text\w*|emph|underline|mbox|uline|url|texorpdfstring|enquote)\s*\{([^{}]*)\}")
TEX_CHAR = re.compile(r"\\([%&_#${}])")


def clean_tex(s: str) -> str:
    s = TEX_DROP.sub("", s)
    while True:
        n = TEX_WRAP.sub(r"\1", TEX_LINK.sub(r"\1", s))
        if n == s:
            break
        s = n
    s = s.replace("\\\\", " ").replace("~", " ")
    s = TEX_CHAR.sub(r"\1", s)
    return plain(s)


def balanced(text: str, at: int) -> int:
    """The place after the brace that closes the one opened before ``at``."""
    depth = 1
    for m in re.compile(r"\\.|[{}]").finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return len(text)


def read_tex(text: str) -> list[Block]:
    out: list[Block] = []
    begin = text.find("\\begin{document}")
    if begin >= 0:
        out.append(Block("preamble", text[:begin]))
        text = text[begin + len("\\begin{document}") :]
        stop = text.find("\\end{document}")
        text = text[:stop] if stop >= 0 else text
    elif text.startswith("\\documentclass"):
        line = text.find("\n")
        out.append(Block("preamble", text[: line if line >= 0 else len(text)]))
        text = text[line:] if line >= 0 else ""
    buf, kind, at, parent = [], "text", 0, 0

    def flush(then="text"):
        nonlocal buf, kind
        s = clean_tex("".join(buf))
        if s:
            out.append(Block(kind, s, parent))
        buf, kind = [], then

    while m := TEX_ENV.search(text, at):
        buf.append(text[at : m.start()])
        at = m.end()
        g = m.lastgroup
        if m["code"]:
            flush()
            out.append(Block("code", m["cb"], parent))
        elif m["eq"]:
            flush()
            out.append(Block("formula", re.sub(r"\\label\{[^}]*\}", "", m["eb"]), parent))
        elif m["db"] is not None or m["dd"] is not None:
            flush(kind if kind == "listitem" else "text")
            out.append(Block("formula", m["db"] if m["db"] is not None else m["dd"], parent))
        elif m["ib"] is not None or m["id"] is not None:
            body = m["ib"] if m["ib"] is not None else m["id"]
            out.append(Block("formula", body, parent))
            buf.append(body)
        elif m["comment"] is not None:
            out.append(Block("comment", m["comment"], parent))
        elif m["sec"]:
            flush()
            end = balanced(text, at)
            out.append(Block("heading", clean_tex(text[at : end - 1]), parent, 1 + m["sec"].count("sub")))
            at = end
            parent += 1
        elif m["item"]:
            flush("listitem")
            parent += 1
        elif m["edge"]:
            flush()
        elif g == "gap":
            flush("text")
    buf.append(text[at:])
    flush()
    return out


# --- wiki -----------------------------------------------------------------------------------------------------

WIKI_ENV = re.compile(r"<(?P<tag>pre|syntaxhighlight|source)\b[^>]*>(?P<code>.*?)</(?P=tag)\s*>|<math\b[^>]*>(?P<math>.*?)</math\s*>|<!--(?P<comment>.*?)-->|<ref\b[^>/]*(?:/>|>(?P<ref>.*?)</ref\s*>)|\{\{(?P<tpl>[^{}]*)\}\}", re.S | re.I)
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
WIKI_URL = re.compile(r"\[(?:https?|ftp|mailto):\S+?(?:\s+([^\]]*))?\]")
QUOTES = re.compile(r"'{2,5}")


def clean_wiki(s: str) -> str:
    s = WIKI_LINK.sub(r"\1", s)
    s = WIKI_URL.sub(lambda m: m[1] or "", s)
    s = QUOTES.sub("", s)
    s = re.sub(r"</?(?:b|i|u|s|small|big|span|sub|sup|nowiki|code|tt|em|strong|br|div|center)\b[^>]*>", lambda m: " " if m.group()[1:3].lower() == "br" else "", s, flags=re.I)
    return plain(html.unescape(s))


def read_wiki(text: str) -> list[Block]:
    out: list[Block] = []
    held: list[Block] = []

    def keep(m):
        if m["code"] is not None:
            code = m["code"] if m["tag"].lower() != "pre" else html.unescape(m["code"])
            held.append(Block("code", code))
            return f"\n\x00{len(held) - 1}\x00\n"
        if m["math"] is not None:
            held.append(Block("formula", m["math"]))
        elif m["comment"] is not None:
            held.append(Block("comment", m["comment"]))
        elif m["tpl"] is not None:
            held.append(Block("template", m["tpl"]))
        else:
            held.append(Block("reference", m["ref"] or ""))
        return f"\x00{len(held) - 1}\x00"

    text = WIKI_ENV.sub(keep, text.replace("\x00", ""))
    buf: list[str] = []
    parent = 0

    def emit(kind, s, level=0):
        def put(m):
            b = held[int(m[1])]
            b.parent = parent
            out.append(b)
            return b.text if b.kind == "formula" else ""

        s = clean_wiki(re.sub(r"\x00(\d+)\x00", put, s))
        if s and not (kind == "text" and out and out[-1].kind == "formula" and plain(out[-1].text) == s):
            out.append(Block(kind, s, parent, level))

    def flush():
        nonlocal buf
        if buf:
            emit("text", "\n".join(buf))
        buf = []

    for line in text.split("\n"):
        h = re.fullmatch(r"\s*(={1,6})\s*(.+?)\s*\1\s*(?:\x00\d+\x00)?\s*", line)
        if h:
            flush()
            parent += 1
            emit("heading", h[2], len(h[1]))
        elif m := re.match(r"([*#:;]*[*#])\s*(.*)", line):
            flush()
            emit("listitem", m[2], len(m[1]))
        elif not line.strip():
            flush()
        else:
            buf.append(line.lstrip(":;"))
    flush()
    return out


# --- Markdown -------------------------------------------------------------------------------------------------

FENCE = re.compile(r"(?m)^(?P<in>[ ]{0,3})(?P<f>`{3,}|~{3,})[^\n]*\n(?P<code>.*?)(?:^[ ]{0,3}(?P=f)[`~]*[ \t]*$|\Z)", re.S)
MD_BLOCK_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
MD_INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s\\$])\$(?![\d$])|\\\((.+?)\\\)")
SPAN = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
MD_LIST = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)(.*)")
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def clean_md(s: str, formulas: list[str] | None = None) -> str:
    """The visible text of a line; formulas found in it are added to the list."""
    held: list[str] = []

    def keep(x):
        held.append(x)
        return f"\x00{len(held) - 1}\x00"

    s = SPAN.sub(lambda m: keep(m[2].strip()), s)

    def math(m):
        body = m[1] if m[1] is not None else m[2]
        if not re.search(r"[\\=^_<>+]|^[A-Za-z]\w?$", body):
            return m.group()
        if formulas is not None:
            formulas.append(re.sub(r"\x00(\d+)\x00", lambda z: held[int(z[1])], body))
        return keep(body)

    s = MD_INLINE_MATH.sub(math, s)
    s = ESCAPE.sub(lambda m: keep(m[1]), s)
    s = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", s)
    s = re.sub(r"\[([^\[\]]*)\]\([^()\s]*(?:\([^()]*\)[^()\s]*)*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", s)
    s = re.sub(r"</?(?:b|i|u|s|em|strong|code|span|br|p|div|sub|sup|a|kbd|small)\b[^>]*>", lambda m: " " if m.group()[1:3].lower() == "br" else "", s, flags=re.I)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", s, flags=re.S)
    for mark in ("__", "_"):
        s = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", s, flags=re.S)
    s = html.unescape(s)
    return plain(re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s))


def read_md(text: str) -> list[Block]:
    out: list[Block] = []
    at, parent = 0, 0

    def prose(part):
        nonlocal parent
        pos = 0
        for m in MD_BLOCK_MATH.finditer(part):
            lines(part[pos : m.start()])
            out.append(Block("formula", m[1] if m[1] is not None else m[2], parent))
            pos = m.end()
        lines(part[pos:])

    def lines(part):
        nonlocal parent
        buf: list[str] = []
        kind, level = "text", 0

        def flush(then="text", deep=0):
            nonlocal buf, kind, level
            if buf:
                found: list[str] = []
                s = clean_md("\n".join(buf), found)
                out.extend(Block("formula", f, parent) for f in found)
                if s:
                    out.append(Block(kind, s, parent, level))
            buf, kind, level = [], then, deep

        part = re.sub(r"<!--(.*?)-->", lambda m: out.append(Block("comment", m[1], parent)) or "", part, flags=re.S)
        for line in part.split("\n"):
            line = re.sub(r"^[ ]{0,3}(?:>[ ]?)+", "", line)
            if not line.strip():
                flush()
            elif h := re.fullmatch(r"[ ]{0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*", line):
                flush("heading", len(h[1]))
                parent += 1
                buf = [h[2] or ""]
                flush()
            elif buf and kind == "text" and re.fullmatch(r"[ ]{0,3}(?:=+|-+)[ \t]*", line):
                kind, level = "heading", 1 if line.strip()[0] == "=" else 2
                parent += 1
                flush()
            elif re.fullmatch(r"[ ]{0,3}(?:[-*_][ \t]*){3,}", line):
                flush()
            elif m := MD_LIST.match(line):
                flush("listitem", 1 + len(m[1].expandtabs(4)) // 2)
                buf.append(m[2])
            else:
                buf.append(line)
        flush()

    for m in FENCE.finditer(text):
        prose(text[at : m.start()])
        out.append(Block("code", m["code"], parent))
        at = m.end()
    prose(text[at:])
    return out


def read_plain(text: str) -> list[Block]:
    out = []
    for part in re.split(r"\n\s*\n", text):
        s = clean_md(clean_wiki(TEX_WRAP.sub(r"\1", re.sub(r"</?[A-Za-z][^<>\n]{0,80}>", " ", part))))
        if s:
            out.append(Block("text", s))
    return out


READERS = {"html": read_html, "latex": read_tex, "wiki": read_wiki, "markdown": read_md, "plain": read_plain}


def blocks(text: str) -> list[Block]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    return READERS[dialect(text)](text)


# --- content or boilerplate -----------------------------------------------------------------------------------


def features(bs: list[Block]) -> np.ndarray:
    """A row per block: link share of it and of its neighbours, wording, and place. The kind of a block is left out."""
    if not bs:
        return np.empty((0, 9))
    size = np.array([max(len(b.text), 1) for b in bs], float)
    link = np.minimum(np.array([b.links for b in bs]) / size, 1.0)
    padded = np.pad(link, 1)
    around = (padded[:-2] + padded[2:]) / np.maximum(np.minimum(np.arange(len(bs)), 1) + np.minimum(np.arange(len(bs))[::-1], 1), 1)  # of the neighbours there are
    many = np.array([min(np.log1p(len(b.text.split())), 6) / 6 for b in bs])
    stops = np.array([sum(b.text.count(c) for c in ".!?,;:") for b in bs]) / size * 20
    digits = np.array([sum(c.isdigit() for c in b.text) for b in bs]) / size
    rights = np.array([float(any(x in b.text.lower() for x in RIGHTS)) for b in bs])
    chrome = np.array([float(b.chrome) for b in bs])
    return np.stack([np.ones(len(bs)), many, link, link * around, np.minimum(stops, 2.0), digits, rights, chrome, link * (1 - many)], axis=1)


#: Signs of notices that stand on every page.
RIGHTS = ("©", "(c) ", "all rights reserved", "cookie", "privacy policy", "terms of use", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos")


def examples() -> list[tuple[list[Block], float]]:
    """Generic documents with their labels, for what a sample may lack: menus, link lists and notices, plain short blocks."""
    link = lambda t, **k: Block("text", t, links=len(t), **k)
    menu = ("Home", "About us", "Contact", "Products", "Log in", "Next page", "Archive", "Read more", "Back to top", "Site map")
    notices = ("© 2020 All rights reserved", "We use cookies. Accept", "Privacy policy | Terms of use", "(c) 1999 by the authors, all rights reserved.")
    short = ("Overview", "First step", "See the table below", "Turn the valve", "Notes on version 2.1", "x = 1", "a_1 + b", "for i in range(3): print(i)", "Each item is listed here, with its number.", "One short sentence.")
    return [([link(t) for t in menu], 0.0), ([link(t, chrome=True) for t in menu], 0.0), ([Block("text", t, chrome=True) for t in menu], 0.0), ([Block("text", t) for t in notices], 0.0), ([Block("text", t) for t in short], 1.0)]


def fit(sample: list[str], rounds: int = 400, rate: float = 0.5, keep: float = 1e-3) -> np.ndarray:
    """A logistic classifier of content. Visible blocks outside navigation are examples of content, those inside it, in
    the sample and in ``examples``, of boilerplate."""
    rows, labels = [], []
    for text in sample:
        bs = [b for b in blocks(text) if b.kind not in HIDDEN]
        rows.append(features(bs))
        labels.append(np.array([0.0 if b.chrome else 1.0 for b in bs]))
    known = [(features(bs), label) for bs, label in examples()]
    # the examples weigh as much as the sample, so a sample without boilerplate does not outvote them
    for x, label in known:
        rows.append(x)
        labels.append(np.full(len(x), label))
    x, y = np.concatenate(rows), np.concatenate(labels)
    told = np.zeros(len(y), bool)
    told[len(y) - sum(len(k) for k, _ in known) :] = True
    weight = np.zeros(len(y))
    for label, group in ((0.0, told), (0.0, ~told), (1.0, told), (1.0, ~told)):
        of = (y == label) & group
        weight[of] = 0.25 / max(of.sum(), 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * 8 * (x.T @ (weight * (p - y)) + keep * w)
    return w


def label_content(bs: list[Block], w: np.ndarray, smooth: float = 1.0, near: float = 0.5) -> list[bool]:
    """True for content: the minimum cut between the classifier's costs under smoothness edges. Blocks that are never
    shown take no part and are no content."""
    shown = [i for i, b in enumerate(bs) if b.kind not in HIDDEN]
    out = [False] * len(bs)
    for i, yes in zip(shown, cut([bs[i] for i in shown], w, smooth, near)):
        out[i] = yes
    return out


def neighbours(bs: list[Block], smooth: float, near: float) -> list[tuple[int, int, float]]:
    """The smoothness edges: neighbouring blocks, and each block with the one before it under the same parent."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            edges.append((i - 1, i, smooth + near * (last.get(b.parent) == i - 1)))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, near))
        last[b.parent] = i
    return edges


def cut(bs: list[Block], w: np.ndarray, smooth: float, near: float) -> list[bool]:
    if not bs:
        return []
    score = features(bs) @ w
    edges = neighbours(bs, smooth, near)
    pull = np.zeros(len(bs))
    for i, j, c in edges:
        pull[i] += c
        pull[j] += c
    # a preference that outweighs all edges of a block decides it in every minimum cut
    fixed = np.abs(score) >= pull
    out = score > 0
    if fixed.all():
        return out.tolist()
    # what is left falls into stretches without an edge between them, each cut for itself
    stretch = {int(v): int(v) for v in np.flatnonzero(~fixed)}

    def top(v):
        while stretch[v] != v:
            stretch[v] = stretch[stretch[v]]
            v = stretch[v]
        return v

    own = {v: [max(score[v], 0.0), max(-score[v], 0.0)] for v in stretch}  # capacities from content and to boilerplate
    inner: list[tuple[int, int, float]] = []
    for i, j, c in edges:
        if i in stretch and j in stretch:
            inner.append((i, j, c))
            stretch[top(i)] = top(j)
        elif i in stretch or j in stretch:
            f, g = (i, j) if i in stretch else (j, i)
            own[f][0 if out[g] else 1] += c
    members: dict[int, list[int]] = {}
    for v in own:
        members.setdefault(top(v), []).append(v)
    between: dict[int, list[tuple[int, int, float]]] = {}
    for e in inner:
        between.setdefault(top(e[0]), []).append(e)
    for root, vs in members.items():
        at = {v: k + 2 for k, v in enumerate(vs)}
        flow = Flow(len(vs) + 2)
        for v in vs:
            flow.join(0, at[v], own[v][0], 0.0)
            flow.join(at[v], 1, own[v][1], 0.0)
        for i, j, c in between.get(root, ()):
            flow.join(at[i], at[j], c, c)
        side = flow.source_side()
        for v in vs:
            out[v] = at[v] in side
    return out.tolist()


class Flow:
    """Maximum flow from node 0 to node 1 by blocking flows over shortest paths."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, u: int, v: int, there: float, back: float) -> None:
        for x, y, c in ((u, v, there), (v, u, back)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self) -> list[int]:
        level = [-1] * len(self.arcs)
        level[0], todo = 0, [0]
        for u in todo:
            for e in self.arcs[u]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self) -> set[int]:
        while (level := self.levels())[1] >= 0:
            following = [0] * len(self.arcs)
            path: list[int] = []
            u = 0
            while True:
                if u == 1:
                    c = min(self.room[e] for e in path)
                    for k, e in enumerate(path):
                        self.room[e] -= c
                        self.room[e ^ 1] += c
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-12)
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while following[u] < len(self.arcs[u]):
                    e = self.arcs[u][following[u]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[u] + 1:
                        break
                    following[u] += 1
                else:
                    if not path:
                        break
                    u = self.to[path.pop() ^ 1]
                    following[u] += 1
                    continue
                path.append(e)
                u = self.to[e]
        return {v for v, d in enumerate(level) if d >= 0}


def content(text: str, w: np.ndarray) -> list[Block]:
    bs = blocks(text)
    return [b for b, yes in zip(bs, label_content(bs, w)) if yes]


def render(bs: list[Block]) -> str:
    """Clean text: headings, items, code and formulas keep a plain sign of what they are."""
    out = []
    for b in bs:
        if b.kind == "heading":
            out.append("#" * min(max(b.level, 1), 6) + " " + b.text)
        elif b.kind == "listitem":
            out.append("  " * max(b.level - 1, 0) + "- " + b.text)
        elif b.kind == "code":
            out.append("```\n" + b.text.strip("\n") + "\n```")
        elif b.kind == "formula":
            out.append("$" + plain(b.text) + "$")
        else:
            out.append(b.text)
    return "\n\n".join(out)


# --- over tables ----------------------------------------------------------------------------------------------


def fit_on(df: DataFrame, id_col: str, text_col: str, sample_rows: int = 400) -> np.ndarray:
    """The classifier, fitted on about ``sample_rows`` texts (twice that at most) chosen by a hash of their id."""
    every = max(1, df.count() // sample_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    return fit([r["text"] for r in chosen.limit(2 * sample_rows).collect()])


def parts(df: DataFrame, id_col: str, text_col: str, w: np.ndarray) -> DataFrame:
    """(id, part_kind, part_text): the distinct headings, list items, code blocks and formulas among the content."""

    def work(batches):
        for b in batches:
            out = ([], [], [])
            for i, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                found = {(x.kind, plain(x.text)): None for x in content(text, w) if x.kind in PARTS}
                for kind, s in found:
                    if s:
                        for col, v in zip(out, (i, kind, s)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string()))], ["id", "part_kind", "part_text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return spread(rows).mapInArrow(work, "id long, part_kind string, part_text string").distinct()


def cleaned(df: DataFrame, id_col: str, text_col: str, w: np.ndarray) -> DataFrame:
    """(id, dialect, text): the clean text of every row; null texts stay null."""

    def work(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            kinds = [dialect(t) if t else None for t in texts]
            clean = [render(content(t, w)) if t is not None else None for t in texts]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(kinds, pa.string()), pa.array(clean, pa.string())], ["id", "dialect", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").dropDuplicates(["id"])
    return rows.mapInArrow(work, "id long, dialect string, text string")
