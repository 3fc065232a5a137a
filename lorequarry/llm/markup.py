"""Markup residue in texts: which kinds are in use, and the clean text (problem 1).

Method: composite text density.  The HTML of a text is read into a DOM whose
root is the text itself.  Every node gets its link-adjusted characters per tag,
its density sum is the sum of its children's densities, and the subtree with the
largest sum whose density reaches the threshold set by the path to the body is
the content.  A block outside that subtree whose density is below the threshold
is boilerplate and dropped, and so is a list made mostly of links; headings,
other lists, tables, code and formulas are kept whatever their density, and so
is text that stands in no block.

Markdown, wiki and LaTeX are rewritten by the same scan that detects them.  Code
blocks and spans, and formulas, are set aside first: what stands in them is
content.  Clean text keeps headings as ``#`` lines, items as ``-`` lines, code
between fences and formulas between dollar signs.

Every pass is linear in the text: a block is closed by looking its closing sign
up in a list made once, never by searching on from each opening sign.  Texts
without any sign of markup never leave the JVM.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorequarry.llm.dressed import is_record

#: Element names of HTML; a sign pair around another word is no tag.
_ELEMENTS = frozenset(
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col "
    "colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol optgroup "
    "option p param picture pre q s samp script section select small source span strike strong style sub summary sup "
    "table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead title tr ul".split()
)
_KEPT = frozenset("h1 h2 h3 h4 h5 h6 ul ol li table tr td th pre code math".split())
#: Elements that part a page into blocks, and elements that part a line.
_BLOCKS = frozenset("address article aside center div fieldset footer form header nav section".split())
_INLINE_PARTS = frozenset("a button label li option span td th time".split())
#: LaTeX commands that stand without braces, and environments that hold formulas or code.
_BARE_COMMANDS = "item maketitle tableofcontents noindent newpage clearpage par hline centering bfseries itshape"
_FORMULAS = "equation align gather multline eqnarray displaymath math cases matrix pmatrix bmatrix split array"
_VERBATIM = "verbatim lstlisting minted"

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*)?|\s*/)>")
_COMMENT = re.compile(r"<!--|<!DOCTYPE\b[^<>]*>", re.IGNORECASE)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_FENCED = re.compile(r"^[ \t]{0,3}(```+|~~~+)[ \t]*+([^\n`]*+)\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_CODE_SPAN = re.compile(r"(?<!`)(`{1,3})(?!`)([^`\n]+)\1(?!`)")
_HTML_CODE = re.compile(r"<(pre|code|kbd|samp|tt|script|style)\b[^<>]*>", re.IGNORECASE)
_PRE_CODE, _PRE_END = re.compile(r"\s*+<code\b[^<>]*>", re.IGNORECASE), re.compile(r"</code\s*>\Z", re.IGNORECASE)
_WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>", re.IGNORECASE)
_TEX_CODE = re.compile(rf"\\begin\{{({_VERBATIM.replace(' ', '|')})\*?\}}", re.IGNORECASE)
_TEX_ENV = re.compile(rf"\\begin\s*+\{{\s*+((?:{_FORMULAS.replace(' ', '|')})\*?)\s*+\}}", re.IGNORECASE)
_TEX_MATH = re.compile(r"\\\[((?:(?!\\\[).)+?)\\\]|\\\(((?:(?!\\\().)+?)\\\)", re.DOTALL)
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?=[^\s$\d]|\d+[^\s\d.,]*[\\^_=+])([^$\n]+?)(?<![\s\\])\$(?![\d$])")
_MATH_SIGN = re.compile(r"\\[A-Za-z]+|[\^_=<>+*/{}|]|^[A-Za-z]$")
_TEX_COMMAND = re.compile(
    rf"(?<![\w:\\])\\(?:begin|end)\s*\{{[^{{}}\n]*\}}|(?<![\w:\\])\\(?:{_BARE_COMMANDS.replace(' ', '|')})(?![A-Za-z_\\])"
    r"|(?<![\w:])\\[A-Za-z]{2,}\*?\s?(?:\[[^\[\]\n]*\])?\{",
    re.IGNORECASE,
)

_WIKI = {
    "heading": re.compile(r"^[ \t]*+(={2,6})(?!=)([^\n]*+)$", re.MULTILINE),
    "link": re.compile(r"\[\[(?![\s\d\[])([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]"),
    "external": re.compile(r"(?<!\[)\[\s?(?:https?|ftp)\s?:\s?//[^\s\[\]]++(?:[ \t]++([^\[\]\n]++))?\](?!\()", re.IGNORECASE),
    "table": re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.DOTALL | re.MULTILINE),
    "bold": re.compile(r"(?<!['\w])('{2,3}|'{5})(?=[^\s'])([^'\n]+(?:'[^'\n]+)*?)(?<!\s)\1(?!')"),
}

_MD = {
    "heading": re.compile(r"^[ ]{0,3}(#{1,6})[ \t]++(\S[^\n]*+)$", re.MULTILINE),
    "setext": re.compile(r"^[ ]{0,3}(\S[^\n]*)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", re.MULTILINE),
    "image": re.compile(r"!\[([^\[\]\n]*)\]\(\s*[^()\s]+(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)"),
    "link": re.compile(r"(?<!!)\[([^\[\]\n]+)\]\(\s*<?[^()\s]+(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)"),
    "autolink": re.compile(r"<((?:https?|ftp)://[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.]+)>"),
    "rule": re.compile(r"[ ]{0,3}\|?[ \t]*+:?-{2,}+:?[ \t]*+(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)*+\|?[ \t]*+"),
    "row": re.compile(r"[ ]{0,3}\|"),
    "bold": re.compile(r"(?<![*\w])(\*\*\*?)(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?!\*)"),
    "open": re.compile(r"(?<![_\w])__(?=[^\s_])"),
    "close": re.compile(r"(?<=[^\s_])__(?![_\w])"),
    "strike": re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)"),
    "italic": re.compile(r"(?<![*\w\\])\*(?=[^\s*\d])([^*\n]+?)(?<=[^\s*])\*(?![*\w])"),
    "quote": re.compile(r"^[ ]{0,3}>[ \t]+(?=\S)", re.MULTILINE),
    "task": re.compile(r"^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+", re.MULTILINE),
}
_TEMPLATE_NAME = re.compile(r"\s*[#A-Za-z一-鿿]")
_TEX_HEAD = r"(?<![\w:])\\[A-Za-z]{2,}\*?\s?(?:\[[^\[\]\n]*\])?\{"
_TEX_BRACE, _TEX_UNWRAP = re.compile(_TEX_HEAD + "|[{}]"), re.compile(_TEX_HEAD + r"([^{}\n]*)\}")
_BULLET = re.compile(r"^[ \t]*([-*+])[ \t]+(?=\S)", re.MULTILINE)
_NUMBER = re.compile(r"^[ \t]*(\d{1,3})([.)])[ \t]+(?=\S)", re.MULTILINE)
_MARK = "\x00"
_SET_ASIDE = re.compile(_MARK + r"(\d+)" + _MARK)
#: What a text must hold to be scanned; all others have no markup and stay as they are.
_SIGN = (
    r"(?im)[<&`*\\$]|__|~~|==|''|--|\[\[|\]\(|\[\s?(?:http|ftp)|\{\{|\{\||\n\n\n|[ \t]\n"
    r"|^[ \t]*(?:#{1,6}|>|[-+]|\d{1,3}[.)])[ \t]+\S"
)
#: What may stand for the mark in a text that holds it: characters reserved for no text, then private ones.
_STAND_INS = [*range(0xFDD0, 0xFDF0), *(p << 16 | n for p in range(17) for n in (0xFFFE, 0xFFFF)), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]


class _Node:
    __slots__ = ("name", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "kept")

    def __init__(self, name: str, parent: _Node | None):
        self.name, self.parent = name, parent
        self.children: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.kept = name in _KEPT


def parse(text: str) -> _Node:
    """DOM of a text, its root the text itself; only known elements are nodes, all else is text."""
    root = at = _Node("body", None)
    open_: dict[str, int] = {}
    done = 0
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name not in _ELEMENTS:
            continue
        if m.start() > done:
            at.children.append(text[done : m.start()])
        done = m.end()
        if m[1]:
            if open_.get(name):
                while at.name != name:
                    open_[at.name] -= 1
                    at = at.parent
                open_[name] -= 1
                at = at.parent
            continue
        if name in ("li", "p", "tr", "td", "th", "dd", "dt") and at.name == name and at.parent is not None:
            open_[name] -= 1
            at = at.parent
        node = _Node(name, at)
        at.children.append(node)
        if name not in _VOID and not m[3].rstrip().endswith("/"):
            at = node
            open_[name] = open_.get(name, 0) + 1
    if done < len(text):
        at.children.append(text[done:])
    return root


def _measure(root: _Node) -> None:
    """Characters, tags and link shares bottom-up, then densities and density sums."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, _Node)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
                node.kept = node.kept or _MARK in c
            else:
                node.chars += c.chars
                node.kept = node.kept or c.kept and not _crowded(c)
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.name == "a" else c.link_chars
                node.link_tags += (c.tags + 1) if c.name == "a" else c.link_tags
    body_share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        if node.chars:
            tags, links, link_tags = max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
            plain = max(node.chars - links, 1)
            base = math.log(node.chars / plain * links + body_share * node.chars + math.e)
            ratio = node.chars / max(links, 1) * tags / link_tags
            node.density = node.chars / tags * max(math.log(max(ratio, 1.0)) / base, 0.0)
        node.total = sum(c.density for c in node.children if isinstance(c, _Node))


def content_node(root: _Node) -> tuple[_Node, float]:
    """The subtree of the largest density sum, and the least density on its path to the body."""
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.total > best.total and node.density >= root.density:
            best = node
        stack += [c for c in node.children if isinstance(c, _Node)]
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _crowded(node: _Node) -> bool:
    """Whether links make up most of a node."""
    return node.link_tags >= 3 and node.link_chars * 10 > node.chars * 8


def _is_boilerplate(node: _Node, inside: bool, above: bool, threshold: float) -> bool:
    """Whether a node that neither is nor holds the content is left out; ``inside`` the content only crowds of links are."""
    if above or node.name in _KEPT and node.name not in ("ul", "ol"):
        return False
    if _crowded(node):
        return not inside or node.density < threshold
    return not inside and node.name in _BLOCKS and not node.kept and node.density < threshold


def _render(root: _Node, content: _Node, threshold: float) -> str:
    """Text of the DOM without boilerplate; an explicit stack, as nesting has no bound."""
    path = {id(content)}
    node = content
    while node.parent is not None:
        node = node.parent
        path.add(id(node))
    out: list[str] = []
    stack: list[tuple[_Node | str, bool]] = [(root, content is root)]
    closed = False  # whether the last thing written was the end of an element that parts a line
    while stack:
        node, inside = stack.pop()
        if isinstance(node, str):
            if node is _END:
                closed = True
            elif node:
                out.append(node)
                closed = False
            continue
        inside = inside or node is content
        if node.parent is not None and _is_boilerplate(node, inside, id(node) in path, threshold):
            continue
        name = node.name
        if name in ("script", "style"):
            continue
        if closed and name in _INLINE_PARTS:
            out.append(" ")
        closed = False
        if name in _BLOCK or name in ("br", "hr"):
            out.append("\n")
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            out.append("\n" + "#" * int(name[1]) + " ")
        elif name == "li":
            out.append("- ")
        after = " | " if name in ("td", "th") else "\n" if name in _BLOCK else _END if name in _INLINE_PARTS else ""
        stack += [(after, inside), *((c, inside) for c in reversed(node.children))]
    return "".join(out)


_END = "".join(("<", "/", ">"))  # a string of its own identity


def _strip_html(text: str) -> str:
    root = parse(text)
    _measure(root)
    content, threshold = content_node(root)
    return _render(root, content, threshold).strip("\n")


def _pieces(text: str) -> Iterator[str]:
    """The braces of a text, and what stands between them."""
    return (p for p in re.split(r"([{}])", text) if p)


def _put(out: list[list[str]], piece: str) -> None:
    """Append text to the last piece of ``out``, or as a new one after a brace."""
    if out and out[-1][0] not in ("{", "}"):
        out[-1].append(piece)
    else:
        out.append([piece])


def unwrap_templates(text: str, made: Callable[[str], str]) -> tuple[str, bool]:
    """``text`` with every ``{{template}}`` replaced by ``made``, the innermost first and at any depth, and whether there was one."""
    out: list[list[str]] = []
    found = False
    for piece in _pieces(text):
        if piece not in ("{", "}"):
            _put(out, piece)
            continue
        out.append([piece])
        if piece == "}" and len(out) > 4 and [p[0] for p in out[-5:-3] + out[-2:]] == ["{", "{", "}", "}"] and out[-3][0] not in ("{", "}"):
            body = "".join(out[-3])
            if _TEMPLATE_NAME.match(body):
                del out[-5:]
                _put(out, made("{{" + body + "}}"))
                found = True
    return "".join(s for p in out for s in p), found


def unwrap_commands(text: str) -> str:
    """``text`` with every LaTeX ``\\command{content}`` on one line replaced by its content, at any depth."""
    out: list[str] = []
    open_: list[list] = []  # of each open brace: its piece, whether a command's, whether its content stays as it is
    at = 0
    for m in _TEX_BRACE.finditer(text):
        out.append(text[at : m.start()])
        if open_ and "\n" in out[-1]:
            open_[-1][2] = True
        at = m.end()
        out.append(m[0])
        if m[0] != "}":
            open_.append([len(out) - 1, m[0] != "{", False])
        elif open_:
            head, command, stays = open_.pop()
            if command and not stays:
                out[head] = out[-1] = ""
            elif open_:
                open_[-1][2] = True
    text = "".join(out) + text[at:]
    # what is left stood in the option of a command that stays
    while (made := _TEX_UNWRAP.sub(r"\1", text)) != text:
        text = made
    return text


class Scan:
    """One pass over a text: the kinds of markup in use, and the rewritten text."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.aside: list[str] = []
        self.text = text
        if _MARK not in text and not is_record(text):
            self._run()

    def _keep(self, content: str) -> str:
        self.aside.append(content)
        return f"{_MARK}{len(self.aside) - 1}{_MARK}"

    def _sub(self, pattern: re.Pattern, kind: str, new: Callable[[re.Match], str | None], *signs: str) -> None:
        """Replace each match; ``None`` leaves it and does not count.  Without one of the ``signs`` there is no match."""
        if signs and not any(sign in self.text for sign in signs):
            return

        def one(m: re.Match) -> str:
            made = new(m)
            if made is None:
                return m[0]
            self.kinds.add(kind)
            return made

        self.text = pattern.sub(one, self.text)

    def _sub_blocks(self, opening: re.Pattern, closing: Callable[[str], str], kind: str, new: Callable[[str, str], str]) -> None:
        """Replace each block from an opening sign to the next closing sign of its name; an open block stays."""
        text, out, done = self.text, [], 0
        if ("<" if kind != "latex" else "\\") not in text:
            return
        ends: dict[str, tuple[list[int], list[int]]] = {}
        for m in opening.finditer(text):
            if m.start() < done:
                continue
            name = m[1].lower()
            if name not in ends:
                found = [e.span() for e in re.finditer(closing(re.escape(name)), text, re.IGNORECASE)]
                ends[name] = [a for a, _ in found], [b for _, b in found]
            begins, stops = ends[name]
            at = bisect_left(begins, m.end())
            if at < len(begins):
                out += [text[done : m.start()], new(name, text[m.end() : begins[at]])]
                done = stops[at]
                self.kinds.add(kind)
        self.text = "".join(out) + text[done:]

    def _sub_comments(self) -> None:
        """Comments and document types go; of a comment that is left open, the opening sign."""
        text, out, done, open_ended = self.text, [], 0, False
        if "<!" not in text:
            return
        for m in _COMMENT.finditer(text):
            if m.start() < done:
                continue
            self.kinds.add("html")
            out.append(text[done : m.start()])
            done = m.end()
            if m[0] == "<!--" and not open_ended:
                end = text.find("-->", m.end())
                open_ended = end < 0
                done = done if open_ended else end + 3
        self.text = "".join(out) + text[done:]

    def _sub_dollars(self) -> None:
        """Formulas between pairs of double dollar signs."""
        text, out, done = self.text, [], 0
        while (begin := text.find("$$", done)) >= 0 and (end := text.find("$$", begin + 3)) >= 0:
            out += [text[done:begin], self._keep(f"$$ {text[begin + 2 : end].strip()} $$")]
            done = end + 2
            self.kinds.add("latex")
        self.text = "".join(out) + text[done:]

    def _sub_underlined(self) -> None:
        """``__bold__``: an opening sign and the next closing one on its line."""
        text = self.text
        if "__" not in text:
            return
        ends = [m.start() for m in _MD["close"].finditer(text)]
        lines = [m.start() for m in re.finditer("\n", text)] + [len(text)]
        out, done = [], 0
        for m in _MD["open"].finditer(text):
            if m.start() < done:
                continue
            at = bisect_left(ends, m.end() + 1)
            if at < len(ends) and ends[at] < lines[bisect_left(lines, m.end())]:
                out += [text[done : m.start()], text[m.end() : ends[at]]]
                done = ends[at] + 2
                self.kinds.add("markdown")
        self.text = "".join(out) + text[done:]

    def _sub_tables(self) -> None:
        """Pipe tables: a line of cells, a rule, and the lines that open with a pipe after it."""
        if "--" not in self.text or "|" not in self.text:
            return
        lines, out, at = self.text.split("\n"), [], 0
        cells = lambda row: " | ".join(c.strip() for c in row.strip().strip("|").split("|"))
        while at < len(lines):
            line = lines[at]
            if at + 1 < len(lines) and "|" in line.lstrip().removeprefix("|") and line.strip(" \t|") and _MD["rule"].fullmatch(lines[at + 1]):
                self.kinds.add("markdown")
                out.append(cells(line))
                at += 2
                while at < len(lines) and _MD["row"].match(lines[at]):
                    out.append(cells(lines[at]))
                    at += 1
            else:
                out.append(line)
                at += 1
        self.text = "\n".join(out)

    def _restore(self) -> str:
        """The text with everything that was set aside; a piece holds only earlier ones."""
        whole: list[str] = []
        back = lambda m: whole[int(m[1])]
        if not self.aside:
            return self.text
        for piece in self.aside:
            whole.append(_SET_ASIDE.sub(back, piece))
        return _SET_ASIDE.sub(back, self.text)

    def _run(self) -> None:
        keep, sub, blocks = self._keep, self._sub, self._sub_blocks
        tag_end = lambda name: rf"</{name}\s*+>"
        sub(_FENCED, "markdown", lambda m: keep(f"```{m[2].strip()}\n{m[3].rstrip()}\n```"), "```", "~~~")
        blocks(_TEX_CODE, lambda name: rf"\\end\{{{name}\*?\}}", "latex", lambda _, x: keep(f"```\n{x.strip()}\n```"))
        blocks(_WIKI_CODE, tag_end, "wiki", lambda _, x: keep(x))
        blocks(_HTML_CODE, tag_end, "html", self._html_code)
        sub(_CODE_SPAN, "markdown", lambda m: keep(f"`{m[2]}`"), "`")
        blocks(_TEX_ENV, lambda name: rf"\\end\s*+\{{\s*+{name}\s*+\}}", "latex", lambda _, x: keep(f"$$ {x.strip()} $$"))
        self._sub_dollars()
        sub(_TEX_MATH, "latex", lambda m: keep(f"$$ {next(g for g in m.groups() if g is not None).strip()} $$"), "\\[", "\\(")
        sub(_DOLLAR, "latex", lambda m: keep(m[0]) if _MATH_SIGN.search(m[1]) else None, "$")
        self._sub_comments()
        # before the headings of other kinds are rewritten to the same form
        sub(_MD["heading"], "markdown", lambda m: f"{m[1]} {m[2].rstrip(' \t').rstrip('#').rstrip(' \t') or m[2][0]}", "#")
        self._wiki()
        self._markdown()
        self._latex()
        self._html()
        self.text = re.sub(r"(?<![ \t])[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", self.text))
        self.text = self._restore()

    def _html_code(self, name: str, text: str) -> str:
        if name in ("script", "style"):
            return ""
        if name != "pre":
            return self._keep(f"`{html.unescape(text)}`")
        if m := _PRE_CODE.match(text):
            text = text[m.end() :]
        return self._keep(f"```\n{html.unescape(_PRE_END.sub('', text.rstrip())).strip()}\n```")

    def _wiki(self) -> None:
        sub = self._sub
        sub(_WIKI["table"], "wiki", lambda m: self._wiki_table(m[0]), "{|")
        if "{{" in self.text:
            self.text, found = unwrap_templates(self.text, self._template)
            if found:
                self.kinds.add("wiki")
        sub(_WIKI["link"], "wiki", lambda m: "" if re.match(r"(?i)(category|分类|kategorie|file|image):", m[1]) and not m[2] else m[2] or m[1], "[[")
        sub(_WIKI["external"], "wiki", lambda m: m[1] or "", "//")
        sub(_WIKI["heading"], "wiki", self._wiki_heading, "==")
        sub(_WIKI["bold"], "wiki", lambda m: m[2], "''")

    @staticmethod
    def _wiki_heading(m: re.Match) -> str | None:
        rest = m[2].rstrip(" \t")
        title = rest.rstrip("=")
        return "#" * len(m[1]) + " " + title.strip() if title.strip() and len(rest) - len(title) == len(m[1]) else None

    @staticmethod
    def _wiki_table(text: str) -> str:
        rows: list[list[str]] = [[]]
        for line in text.split("\n")[1:]:
            mark = line.strip()
            if mark.startswith("|-"):
                rows.append([])
            elif mark.startswith(("!", "|")) and not mark.startswith("|}"):
                rows[-1] += [c.strip() for c in re.split(r"\|\||!!", mark[1:])]
        return "\n".join(" | ".join(r) for r in rows if r)

    @staticmethod
    def _template(text: str) -> str:
        name, *fields = text[2:-2].split("|")
        return ", ".join(f.strip() for f in fields if f.strip()) or name.strip()

    def _markdown(self) -> None:
        sub = self._sub
        self._sub_tables()
        sub(_MD["image"], "markdown", lambda m: m[1], "![")
        sub(_MD["link"], "markdown", lambda m: m[1], "](")
        sub(_MD["autolink"], "markdown", lambda m: m[1], "<")
        sub(_MD["setext"], "markdown", lambda m: None if _BULLET.match(m[1]) or "|" in m[1] else f"{'#' if m[2][0] == '=' else '##'} {m[1]}", "---", "===")
        sub(_MD["bold"], "markdown", lambda m: m[2], "**")
        self._sub_underlined()
        sub(_MD["strike"], "markdown", lambda m: m[1], "~~")
        sub(_MD["italic"], "markdown", lambda m: m[1], "*")
        sub(_MD["quote"], "markdown", lambda m: "", ">")
        sub(_MD["task"], "markdown", lambda m: f"{m[1]}- ", "[ ]", "[x]", "[X]")
        for pattern in (_BULLET, _NUMBER):
            if len(pattern.findall(self.text)) > 1:
                self.kinds.add("markdown")
        self.text = _BULLET.sub("- ", self.text)

    def _latex(self) -> None:
        if "\\" not in self.text or not _TEX_COMMAND.search(self.text):
            return
        self.kinds.add("latex")
        t = re.sub(r"\\(part|chapter|(?:sub)*section|paragraph)\*?\s*\{([^{}\n]*)\}", lambda m: "#" * (1 + m[1].lower().count("sub")) + " " + m[2], self.text, flags=re.IGNORECASE)
        t = re.sub(r"(?<![ \t])[ \t]*\\item\b\s*(?:\[([^\[\]\n]*)\])?[ \t]*", lambda m: "- " + (f"{m[1]} " if m[1] else ""), t, flags=re.IGNORECASE)
        t = re.sub(r"\\(?:begin|end)\s*\{[^{}\n]*\}(?:\[[^\[\]\n]*\])?\n?", "", t, flags=re.IGNORECASE)
        t = re.sub(r"~?\\(?:label|vspace|hspace)\*?\s?\{[^{}\n]*\}", "", t, flags=re.IGNORECASE)
        t = re.sub(r"~(?=\\)", " ", t)
        t = unwrap_commands(t)
        self.text = re.sub(rf"(?<![\w:\\])\\(?:{_BARE_COMMANDS.replace(' ', '|')})(?![A-Za-z_\\])[ \t]?", "", t, flags=re.IGNORECASE)

    def _html(self) -> None:
        if "<" in self.text and any(m[2].lower() in _ELEMENTS for m in _TAG.finditer(self.text)):
            self.kinds.add("html")
            self.text = _strip_html(self.text)
        if "&" in self.text and any(html.unescape(m[0]) != m[0] for m in _ENTITY.finditer(self.text)):
            self.kinds.add("html")
            self.text = _ENTITY.sub(lambda m: html.unescape(m[0]), self.text)


def scan_any(text: str) -> Scan:
    """The scan of a text; one with the mark is scanned with a character in its place that is absent from the text."""
    if _MARK not in text:
        return Scan(text)
    known = text + html.unescape(text)  # a reference must not turn into it either
    stand_in = next(c for c in map(chr, _STAND_INS) if c not in known)
    scan = Scan(text.replace(_MARK, stand_in))
    scan.text = scan.text.replace(stand_in, _MARK)
    return scan


def clean_markup(rows: DataFrame, text_col: str = "page_content", id_col: str = "row_id") -> DataFrame:
    """``(row_id, markups, clean_text)``: the kinds of markup of each text, sorted, and its clean text.

    Kinds are ``html``, ``latex``, ``markdown`` and ``wiki``.  Records (JSON
    objects, ``key: value`` lines) have no markup and stay as they are.  Null and empty texts give no kinds and are
    returned as they are.  Repeated rows are cleaned each on their own.
    """

    @F.arrow_udf("markups array<string>, clean_text string")
    def scanned(texts: pa.Array) -> pa.Array:
        kinds, clean = [], []
        for text in texts:
            scan = scan_any(text.as_py()) if text.is_valid else None
            kinds.append(sorted(scan.kinds) if scan else None)
            clean.append(scan.text if scan else None)
        return pa.StructArray.from_arrays([pa.array(kinds, pa.list_(pa.string())), pa.array(clean, pa.string())], ["markups", "clean_text"])

    texts = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    # else the filter that explode infers would scan every text a second time
    scanned = scanned.asNondeterministic()
    signed = F.when(F.col("text").rlike(_SIGN), F.col("text"))
    none = F.array().cast("array<string>")
    return texts.withColumn("s", scanned(signed)).select(
        "row_id", F.coalesce("s.markups", none).alias("markups"), F.coalesce("s.clean_text", "text").alias("clean_text")
    )


def markup_found(cleaned: DataFrame) -> DataFrame:
    """``(row_id, markup)``: one row for each text and kind in use."""
    return cleaned.select("row_id", F.explode("markups").alias("markup"))
