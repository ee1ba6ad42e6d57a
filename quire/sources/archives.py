"""Documents as zipped books and word-processor files, a row each: EPUB 3 and DOCX."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages of a chapter, deepest headings, characters that XML can't hold.
CHAPTER, DEEPEST = 20, 6
NO_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
RTL = re.compile("[֐-ࣿיִ-﷿ﹰ-ﻼ]")
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _clean(text: str | None) -> str:
    return NO_XML.sub("", text or "")


def _zipped(files: list[tuple[str, str]]) -> bytes:
    """The first file is stored, the others compressed; no times, so equal documents are equal bytes."""
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for k, (name, content) in enumerate(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content.encode(), zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
    return made.getvalue()


def _page(title: str, lang: str, body: str) -> str:
    return f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang={quoteattr(lang)}><head><title>{escape(title)}</title><link rel="stylesheet" href="../main.css"/></head><body>{body}</body></html>'


def _element(block: dict) -> str:
    text, kind = escape(_clean(block["text"])), block["kind"]
    # a chapter's own heading takes the first level
    tag = f"h{min(block['level'] + 1, DEEPEST)}" if kind == "heading" else "pre" if kind == "code" else "p"
    direction = ' dir="rtl"' if (first := re.search(r"[^\W\d_]", text)) and RTL.match(first.group()) else ""
    return f"<{tag}{direction}>{text}</{tag}>"


def epub_bytes(name: str, title: str, lang: str, modified: str, blocks: list[dict]) -> bytes:
    """A book of chapters of twenty pages that hold text; `modified` is an ISO time."""
    pages = sorted({b["page"] for b in blocks if (b["text"] or "").strip()})
    groups = [pages[k : k + CHAPTER] for k in range(0, len(pages), CHAPTER)] or [[]]
    label = lambda g: "Empty" if not g else f"Page {g[0] + 1}" if len(g) == 1 else f"Page {g[0] + 1}–{g[-1] + 1}"
    of = {p: k for k, g in enumerate(groups) for p in g}
    bodies: list[list[str]] = [[f"<h1>{label(g)}</h1>"] for g in groups]
    for b in blocks:
        if (b["text"] or "").strip():
            bodies[of[b["page"]]].append(_element(b))
    chapters = [f"chap_{k + 1}" for k in range(len(groups))]
    title = _clean(title)
    items = "".join(f'<item id="{c}" href="text/{c}.xhtml" media-type="application/xhtml+xml"/>' for c in chapters)
    opf = (
        f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{escape(_clean(name))}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(lang)}</dc:language><meta property="dcterms:modified">{escape(modified)}</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="main.css" media-type="text/css"/>{items}</manifest>'
        f'<spine>{"".join(f"""<itemref idref="{c}"/>""" for c in chapters)}</spine></package>'
    )
    entries = "".join(f'<li><a href="text/{c}.xhtml">{label(g)}</a></li>' for c, g in zip(chapters, groups, strict=True))
    files = [
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", opf),
        ("OEBPS/nav.xhtml", _page(title, lang, f'<nav epub:type="toc"><ol>{entries}</ol></nav>').replace("../main.css", "main.css")),
        ("OEBPS/main.css", "body { line-height: 1.5 }\npre { white-space: pre-wrap }\n"),
    ]
    return _zipped(files + [(f"OEBPS/text/{c}.xhtml", _page(label(g), lang, "".join(body))) for c, g, body in zip(chapters, groups, bodies, strict=True)])


_WORDS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _paragraph(block: dict, first: bool) -> str:
    """Lines of a block are lines of a paragraph; a new page begins on a new page."""
    style = f'<w:pStyle w:val="Heading{min(block["level"], DEEPEST)}"/>' if block["kind"] == "heading" else ""
    face = '<w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/></w:rPr>' if block["kind"] == "code" else ""
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in _clean(block["text"]).split("\n"))
    return f"<w:p><w:pPr>{style}{'<w:pageBreakBefore/>' if first else ''}</w:pPr><w:r>{face}{lines}</w:r></w:p>"


def docx_bytes(name: str, title: str, lang: str, modified: str, blocks: list[dict]) -> bytes:
    body, page = [], None
    for b in blocks:
        if (b["text"] or "").strip():
            body.append(_paragraph(b, page is not None and b["page"] != page))
            page = b["page"]
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{40 - 4 * k}"/></w:rPr></w:style>' for k in range(1, DEEPEST + 1)
    )
    kind, rel = "application/vnd.openxmlformats-", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = lambda *of: f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="r{k}" Type="{t}" Target="{to}"/>""" for k, (t, to) in enumerate(of))}</Relationships>'
    core = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
    return _zipped([
        ("[Content_Types].xml", f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{kind}package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}officedocument.wordprocessingml.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="{kind}package.core-properties+xml"/></Types>'),
        ("_rels/.rels", links((f"{rel}/officeDocument", "word/document.xml"), ("http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "docProps/core.xml"))),
        ("docProps/core.xml", f'{HEAD}<cp:coreProperties xmlns:cp="{core}" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier>{escape(_clean(name))}</dc:identifier><dc:title>{escape(_clean(title))}</dc:title><dc:language>{escape(lang)}</dc:language></cp:coreProperties>'),
        ("word/_rels/document.xml.rels", links((f"{rel}/styles", "styles.xml"))),
        ("word/styles.xml", f"{HEAD}<w:styles {_WORDS}>{styles}</w:styles>"),
        ("word/document.xml", f"{HEAD}<w:document {_WORDS}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>"),
    ])


def _files(rows: DataFrame, doc: str, page: str, order: str, lang: str, modified: str, make: Callable[..., bytes]) -> DataFrame:
    block = F.struct(F.col(page).cast("int").alias("page"), F.col(order).alias("o"), "kind", F.coalesce(F.col("level").cast("int"), F.lit(1)).alias("level"), "text")
    docs = rows.groupBy(doc).agg(F.min_by("title", F.struct(page, order)).alias("title"), F.sort_array(F.collect_list(block)).alias("blocks"))

    @F.pandas_udf("binary")
    def built(names: pd.Series, titles: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([make(n, t or n, lang, modified, list(b)) for n, t, b in zip(names, titles, blocks, strict=True)], dtype=object)

    return docs.select(doc, built(F.col(doc).cast("string"), "title", "blocks").alias("content"))


def epub(rows: DataFrame, doc: str, page: str, order: str, lang: str = "und", modified: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(doc, content) of blocks with page (from 0), order, kind, level, text, title. A document must fit a row; documents spread over tasks."""
    return _files(rows, doc, page, order, lang, modified, epub_bytes)


def docx(rows: DataFrame, doc: str, page: str, order: str, lang: str = "und") -> DataFrame:
    """(doc, content) as for `epub`."""
    return _files(rows, doc, page, order, lang, "", docx_bytes)
