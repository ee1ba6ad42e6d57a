"""Markup and programs: an allow-list for HTML, tokens of code. Both need a scanner's state, so they take Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stay of a text's markup.
TAGS = frozenset(
    "p div span br hr h1 h2 h3 h4 h5 h6 strong b em i u s mark small sub sup blockquote pre code ul ol li dl dt dd table thead tbody tr th td "
    "caption figure figcaption section article header footer aside nav a img style font".split()
)
ATTRIBUTES = frozenset(
    "class id style dir lang xml:lang title data-block-id data-page data-role href src alt width height color face size align valign colspan rowspan charset media rel".split()
)
# Attributes that hold no address, elements that go with what is inside, elements without an end.
NO_ADDRESS = frozenset("alt class id title style".split())
EMPTIED = frozenset("audio head iframe math noembed noframes noscript object script select svg template textarea title video xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SAFE_ADDRESS = re.compile(r"(?:https?|mailto|tel):|[^a-z]|[a-z+.-]+(?:[^a-z+.\-:]|$)", re.IGNORECASE)
IGNORED = re.compile("[\x00-\x20  ᠎ -  　]")


class _Allowed(HTMLParser):
    """Writes what is allowed as it is read; what is open at the end is closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped or tag in EMPTIED:
            if tag not in VOID and (not self.skipped or tag == self.skipped[0]):
                self.skipped.append(tag)
            return
        if tag not in TAGS:
            return
        kept: dict[str, str] = {}
        for name, value in attrs:
            if name not in kept and self.allows(tag, name, value or ""):
                kept[name] = value or ""
        self.out.append(f"<{tag}{''.join(f' {n}="{html.escape(v)}"' for n, v in kept.items())}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash closes nothing in HTML but what is void
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[0]:
                self.skipped.pop()
        elif tag in self.open:
            while self.open[-1] != tag:
                self.out.append(f"</{self.open.pop()}>")
            self.out.append(f"</{self.open.pop()}>")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            raw = self.open and self.open[-1] == "style"
            self.out.append(data.replace("<", "") if raw else html.escape(data, quote=False))

    @staticmethod
    def allows(tag: str, name: str, value: str) -> bool:
        bare = IGNORED.sub("", value)
        image = tag == "img" and name == "src" and bare[:5].lower() == "data:"
        return (name in ATTRIBUTES or name.startswith("aria-")) and (not bare or name in NO_ADDRESS or image or bool(SAFE_ADDRESS.match(bare)))


def sanitised_text(text: str | None) -> str | None:
    """`text` with allowed tags, attributes and addresses alone; other tags leave their content, scripts and the like go whole. Null stays null."""
    if not text:
        return text
    parser = _Allowed()
    parser.feed(text)
    parser.close()
    return "".join(parser.out) + "".join(f"</{tag}>" for tag in reversed(parser.open))


def sanitised(text: Column) -> Column:
    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(sanitised_text, na_action="ignore")

    return each(text)


# Words that programs keep for themselves, and directives of a preprocessor.
KEYWORDS = frozenset(
    "auto break case char const continue default delete do double else enum extern float for goto if inline int long operator register return short "
    "signed sizeof static struct switch typedef union unsigned void volatile while class namespace new template typename public private protected "
    "virtual override final friend try catch throw nullptr true false using constexpr explicit as async await export extends from function import in "
    "instanceof let of super typeof var with yield undefined null get set this and assert def del elif global lambda nonlocal not or pass raise is None "
    "True False chan defer go map range type func interface package fn mut match impl use pub crate mod trait where loop move ref dyn fi esac done "
    "insert update join inner left right full outer group order having values create table index view begin commit rollback drop alter primary foreign "
    "references select".split()
)
DIRECTIVES = "include define undef ifdef ifndef if elif else endif error warning line pragma import region endregion".split()

_PIECES = {
    "comment": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
    "keyword": rf"#(?i:{'|'.join(DIRECTIVES)})(?![A-Za-z])",
    "note": r"#[^\n]*",
    "string": "|".join(rf"{q * 3}(?:\\.?|(?!{q * 3})[^\\])*(?:{q * 3})?" for q in "\"'`") + "|" + "|".join(rf"{q}(?:\\.?|[^\\{q}{nl}])*{q}?" for q, nl in (('"', r"\n"), ("'", r"\n"), ("`", ""))),
    "number": "[0-9][0-9A-Za-z_.]*",
    "word": "[A-Za-z_$\x80-\U0010ffff][0-9A-Za-z_$\x80-\U0010ffff]*",
    "plain": ".",
}
_PIECE = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _PIECES.items()), re.DOTALL)
_CALL = re.compile(r"[ \t]*\(")


def code_pieces(code: str | None) -> list[dict] | None:
    """[{text, kind}] whose texts make up the code; neighbours of a kind are one. A name after a dot is never a keyword."""
    if code is None:
        return None
    out: list[dict] = []
    for m in _PIECE.finditer(code):
        kind = m.lastgroup
        if kind == "note":
            kind = "comment"
        elif kind == "word":
            member = code[m.start() - 1 : m.start()] == "."
            kind = "keyword" if m.group() in KEYWORDS and not member else "function" if _CALL.match(code, m.end()) else "plain"
        if out and out[-1]["kind"] == kind:
            out[-1]["text"] += m.group()
        else:
            out.append({"text": m.group(), "kind": kind})
    return out


def code_tokens(code: Column) -> Column:
    @F.pandas_udf("array<struct<text:string,kind:string>>")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(code_pieces, na_action="ignore")

    return each(code)


def highlighted(tokens: Column) -> Column:
    """Markup of tokens: a span for each that isn't plain."""
    from quire.functions.text import escape_html

    mark = lambda p: F.when(p["kind"] == "plain", escape_html(p["text"])).otherwise(F.concat(F.lit('<span class="tok-'), p["kind"], F.lit('">'), escape_html(p["text"]), F.lit("</span>")))
    return F.array_join(F.transform(tokens, mark), "")
