"""Main content, links and title of HTML pages, by the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import flat_map

#: Elements without shown text, those that never close, and those that end a line. Fixed values.
HIDDEN = {"script", "style", "template", "noscript", "svg", "head"}
CHROME = {"nav", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINE_ENDS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "main"}
LINKS, RESOURCES = 512, 128
#: Roots of content in the order that decides between equal scores, and what a heading (first three levels), a link and a picture in one count. Fixed values.
ROOTS, WEIGHTS = {"main": 0, "article": 1, "role": 2}, (120, 18, 24)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.title, self.canonical, self.order = "", "", 0
        self.links: list[str] = []
        self.images: list[str] = []
        self.parts: list[str] = []
        self.headings = self.pictures = self.targets = 0
        self.roots: list[tuple] = []  # open roots: depth, sort, and where their text and counts begin
        self.found: list[tuple[int, int, int, str]] = []  # score, sort and place (smaller first), text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        hidden = tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true"
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "img" and (a.get("src") or a.get("srcset")):
            self.images.append(best_source(a.get("srcset") or "") or a.get("src") or "")
        if tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href") or ""
        self.headings += tag in ("h1", "h2", "h3")
        self.targets += tag == "a" and "href" in a
        self.pictures += tag == "img"
        sort = ROOTS.get(tag, ROOTS["role"] if a.get("role") == "main" else None)
        if sort is not None and tag not in VOID:
            self.roots.append((len(self.stack), sort, self.order, len(self.parts), self._counts()))
            self.order += 1
        if tag not in VOID:
            self.stack.append((tag, hidden))
        if tag in LINE_ENDS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            top, _ = self.stack.pop()
            if top in LINE_ENDS:
                self.parts.append("\n")
            if self.roots and self.roots[-1][0] == len(self.stack):
                self._close_root()
            if top == tag:
                break

    def _counts(self) -> tuple[int, int, int]:
        return self.headings, self.targets, self.pictures

    def _close_root(self) -> None:
        """A root's score: characters of its text, and what its headings, links and pictures count."""
        _, sort, order, at, before = self.roots.pop()
        parts = self.parts[at:]
        counts = [now - then for now, then in zip(self._counts(), before, strict=True)]
        score = len(" ".join(" ".join(parts).split())) + sum(w * n for w, n in zip(WEIGHTS, counts, strict=True))
        if score:
            self.found.append((score, -sort, -order, tidy("".join(parts))))

    def finish(self) -> str:
        """The text of the best root, also of those that never closed; of all, without one."""
        while self.roots:
            self._close_root()
        return max(self.found)[3] if self.found else tidy("".join(self.parts))

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _ in self.stack):
            self.title += data
        elif not any(h or t in CHROME for t, h in self.stack):
            self.parts.append(data)


def tidy(text: str) -> str:
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def best_source(srcset: str) -> str:
    """The candidate of the greatest width or density."""
    best, most = "", -1.0
    for part in srcset.split(","):
        bits = part.split()
        size = float(bits[1][:-1]) if len(bits) > 1 and bits[1][:-1].replace(".", "", 1).isdigit() else 1.0
        if bits and size > most:
            best, most = bits[0], size
    return best


def normal_url(url: str, base: str = "") -> str:
    """Absolute, host in lower case, no fragment, no default port, at least ``/``; the query stays."""
    try:
        u = urlsplit(urljoin(base, url))
        port = u.port
    except ValueError:
        return ""
    if u.scheme not in ("http", "https") or not u.hostname:
        return ""
    host = u.hostname + (f":{port}" if port and port != {"http": 80, "https": 443}[u.scheme] else "")
    return urlunsplit((u.scheme, host, u.path or "/", u.query, ""))


def read_page(html: str, url: str = "") -> tuple[str, str, str, list[str], list[str]]:
    """(title, text, canonical URL, links, images); the text is of the best ``main``, ``article`` or element of that role, else of all."""
    page = _Page()
    page.feed(html)
    page.close()
    text = page.finish()
    links = list(dict.fromkeys(x for x in (normal_url(h, url) for h in page.links) if x))[:LINKS]
    images = list(dict.fromkeys(x for x in (normal_url(h, url) for h in page.images) if x))[:RESOURCES]
    return " ".join(page.title.split()), text, normal_url(page.canonical, url) if page.canonical else normal_url(url), links, images


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: ``(id, title, text, canonical_url, links, images)``."""

    def run(key: object, url: str | None, html: str | None) -> Iterator[tuple]:
        yield key, *read_page(html or "", url or "")

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df.select(id_col, url_col, html_col), run, f"`{id_col}` {kind}, title string, text string, canonical_url string, links array<string>, images array<string>")


def raw_title(html: Column) -> Column:
    """The first plain ``<title>`` as it is written, ``&amp;`` alone decoded and blanks as one space; empty without one.

    ``read_page`` has the title as a browser shows it, with all character references decoded.
    """
    title = F.replace(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(title, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def normal_url_column(url: Column) -> Column:
    """As ``normal_url`` for absolute URLs, in expressions."""
    parts = lambda i: F.regexp_extract(url, r"^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?", i)
    host = F.when(parts(1) == "https", F.regexp_replace(F.lower(parts(2)), ":443$", "")).otherwise(F.regexp_replace(F.lower(parts(2)), ":80$", ""))
    path = F.when(parts(3) == "", "/").otherwise(parts(3))
    return F.concat(parts(1), F.lit("://"), host, path, parts(4))


def host_relation(host: Column, seed: Column) -> Column:
    """same, subdomain or external; a look-alike without the dot is external."""
    return F.when(host == seed, "same").when(F.endswith(host, F.concat(F.lit("."), seed)), "subdomain").otherwise("external")
