"""Text and links of HTML pages, by the standard library's parser inside Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Letters that go on a word cut by a line end, elements that hold no content, and those that end a line.
LOWER = "abcdefghijklmnopqrstuvwxyzçğıöşü"
SKIPPED = frozenset({"script", "style", "noscript", "svg", "nav", "footer"})
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header blockquote pre hr dt dd main body".split())
#: Characters that are dropped, and the blank that is a space: everything unseen but tabs, line ends and form feeds.
_UNSEEN = dict.fromkeys([c for c in range(0x20) if chr(c) not in "\t\n\f\r"] + [0x7F, 0xAD, 0x200B, 0xFFFD]) | {0xA0: " "}


def tidy(text: str) -> str:
    """Composed characters, nothing unseen, words joined over line ends, single blanks, one empty line at most.

    Taken line by line: a line that ends in a hyphen after a letter goes on in
    the next one, if that begins in lower case.
    """
    shown = unicodedata.normalize("NFC", text).translate(_UNSEEN).replace("\r\n", "\n").replace("\r", "\n")
    lines: list[str] = []
    for line in shown.split("\n"):
        begin = line.lstrip("\t ")[:1]
        if lines and lines[-1][-1:] == "-" and (lines[-1][-2:-1].isalnum() or lines[-1][-2:-1] == "_") and (begin in LOWER and begin):
            lines[-1] = lines[-1][:-1] + line.lstrip("\t ")
        else:
            lines.append(line)
    out: list[str] = []
    for line in lines:
        words = " ".join(w for w in line.replace("\t", " ").split(" ") if w)
        if words or out[-1:] != [""]:
            out.append(words)
    return "\n".join(out).strip()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[list[str]] = []
        self.depth = 0
        self.paths: set[str] = set()
        self.stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in SKIPPED:
            self.depth += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "a" and values.get("href"):
            self.links.append([values["href"], values.get("title") or "", ""])
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.stack.append(".".join([tag, *sorted((values.get("class") or "").split())]))
            self.paths.add(">".join(self.stack[-3:]))

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1
        if tag in ("td", "th"):
            self.out.append(" ")
        if tag in BLOCKS:
            self.out.append("\n")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].split(".")[0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not self.depth:
            text = re.sub(r"\s+", " ", data)
            self.out.append(text)
            if self.links:
                self.links[-1][2] += text if self.stack and any(s.split(".")[0] == "a" for s in self.stack) else ""


def read(page: str) -> _Reader:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader


@pandas_udf(StringType())
def html_text(page: pd.Series) -> pd.Series:
    return pd.Series([tidy("".join(read(x).out)) for x in page])


_LINK = StructType([StructField("url", StringType()), StructField("title", StringType())])


@pandas_udf(ArrayType(_LINK))
def page_links(page: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute links without fragments, each URL once, with text or else the title attribute."""

    def of(text: str, root: str) -> list[dict]:
        seen: dict[str, str] = {}
        for href, title, inner in read(text).links:
            url = urldefrag(urljoin(root or "", href.strip()))[0]
            if url.startswith("http"):
                seen.setdefault(url, inner.strip() or title)
        return [{"url": u, "title": t} for u, t in seen.items()]

    return pd.Series([of(x, b) for x, b in zip(page, base, strict=True)])


@pandas_udf(ArrayType(StringType()))
def structure_paths(page: pd.Series) -> pd.Series:
    """Up to 50 paths of tags and classes, three levels deep: what a page's structure is told by."""
    return pd.Series([sorted(read(x).paths)[:50] for x in page])


@pandas_udf(StringType())
def normal_text(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else tidy(x) for x in text])


@pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else html.unescape(x) for x in text])


@pandas_udf(StringType())
def decoded(content: pd.Series, header: pd.Series) -> pd.Series:
    """Bytes as text: by the header's charset, the page's own, UTF-8, or else Windows-1254."""

    def of(data: bytes, kind: str | None) -> str:
        named = re.search(r"charset=[\"']?([\w-]+)", kind or "") or re.search(r"charset=[\"']?([\w-]+)", data[:4096].decode("latin-1"))
        for name in (named[1] if named else None, "utf-8"):
            try:
                if name:
                    return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return data.decode("cp1254", "replace")

    return pd.Series([None if x is None else of(bytes(x), k) for x, k in zip(content, header, strict=True)])


@pandas_udf(ArrayType(StringType()))
def paragraph_chunks(text: pd.Series) -> pd.Series:
    """Lines packed in order into chunks of at most 4000 characters; longer lines are cut."""

    def of(whole: str, size: int = 4000) -> list[str]:
        out: list[str] = []
        for line in (whole or "").split("\n"):
            for piece in [line[k : k + size] for k in range(0, len(line), size)] or [""]:
                if out and len(out[-1]) + 1 + len(piece) <= size:
                    out[-1] += "\n" + piece
                else:
                    out.append(piece)
        return [x for x in out if x.strip()]

    return pd.Series([of(x) for x in text])
