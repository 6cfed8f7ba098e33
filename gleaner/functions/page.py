"""Facts of web pages: a small document tree and what is read from it, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .text import EMAIL, PHONE

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Mail domains of examples, and social paths that are no profiles.
PLACEHOLDER_DOMAINS = {"example.com", "example.org", "example.net", "domain.com", "email.com", "sentry.io"}
RESERVED_PATHS = {"p", "reel", "reels", "explore", "stories", "accounts", "about", "sharer", "sharer.php", "share", "dialog", "plugins", "login", "tr", "pages", "groups", "events"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        """Text without scripts and styles, white space collapsed."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style", "template", "noscript"):
                stack.extend(reversed(n.children))
                out.append(" ")
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def json_ld(root: Node, kind: str) -> list[dict]:
    """All objects of a type in the page's linked data, nested graphs included."""
    found, waiting = [], deque()
    for n in root.find_all("script"):
        if "ld+json" in n.attrs.get("type", ""):
            try:
                waiting.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                continue
    while waiting:
        x = waiting.popleft()
        if isinstance(x, list):
            waiting += x
        elif isinstance(x, dict):
            types = x.get("@type")
            if kind == types or (isinstance(types, list) and kind in types):
                found.append(x)
            waiting += [v for v in x.values() if isinstance(v, (list, dict))]
    return found


def label_pairs(root: Node) -> list[tuple[str, str]]:
    """Label and value of definition lists, table rows and strong or label elements before a value."""
    pairs = []
    for n in root.find_all("dt", "th", "label", "strong", "b"):
        if n.parent is None:
            continue
        after = n.parent.children[n.parent.children.index(n) + 1 :]
        want = {"dt": ("dd",), "th": ("td",)}.get(n.tag)
        label = n.text().rstrip(" :")
        for c in after:
            if isinstance(c, str):
                if want is None and c.strip(" :\n\t"):
                    pairs.append((label, " ".join(c.strip(" :\n\t").split())))
                    break
            elif want is None or c.tag in want:
                if c.text():
                    pairs.append((label, c.text()))
                break
    return pairs


def contacts(root: Node, domain: str | None = None) -> dict[str, str | None]:
    """E-mail, phone and social profiles: links before text, own domain before others, examples left out."""
    links = [n.attrs.get("href", "") for n in root.find_all("a")]
    text = root.text()
    mails = [h[7:].split("?")[0].strip().lower() for h in links if h.lower().startswith("mailto:")] + [m.lower() for m in re.findall(EMAIL, text)]
    mails = [m for m in mails if "@" in m and m.split("@")[1] not in PLACEHOLDER_DOMAINS]
    own = [m for m in mails if domain and m.split("@")[1].removeprefix("www.") == domain]
    phones = [h[4:].strip() for h in links if h.lower().startswith("tel:")] + re.findall(PHONE, text)

    def profile(site: str) -> str | None:
        for h in links:
            m = re.match(rf"https?://(?:www\.|m\.)?{site}/([^/?#]+)", h, re.I)
            if m and m[1].lower() not in RESERVED_PATHS:
                return m[1]
        return None

    whats = [m[1] for h in links if (m := re.match(r"(?:https?://wa\.me/|https?://api\.whatsapp\.com/send\?phone=|whatsapp://send\?phone=)\+?(\d+)", h, re.I))]
    return {
        "email": (own or mails or [None])[0],
        "phone": phones[0] if phones else None,
        "whatsapp": whats[0] if whats else None,
        "instagram": profile(r"instagram\.com"),
        "facebook": profile(r"facebook\.com"),
    }


def job_posting(root: Node) -> dict[str, str | None]:
    """Facts of the page's only job posting: linked data before labels in the text; all null on an overview."""
    posts = json_ld(root, "JobPosting")
    out: dict[str, str | None] = dict.fromkeys(("title", "company", "location", "posted_date", "contract_type", "hours"))
    if len(posts) > 1:
        return out

    def name(x: object) -> str | None:
        if isinstance(x, list):
            x = x[0] if x else None
        if isinstance(x, dict):
            x = x.get("name")
        return x.strip() or None if isinstance(x, str) else None

    if posts:
        p = posts[0]
        place = p.get("jobLocation")
        place = place[0] if isinstance(place, list) and place else place
        address = place.get("address") if isinstance(place, dict) else None
        out.update(
            title=name(p.get("title")),
            company=name(p.get("hiringOrganization")),
            location=address.get("addressLocality") if isinstance(address, dict) else name(address),
            posted_date=m[0] if isinstance(p.get("datePosted"), str) and (m := re.match(r"\d{4}-\d{2}-\d{2}", p["datePosted"])) else None,
            contract_type=name(p.get("employmentType")),
        )
    names = {"bedrijf": "company", "werkgever": "company", "company": "company", "locatie": "location", "standplaats": "location", "location": "location", "uren": "hours", "hours": "hours", "contract": "contract_type", "dienstverband": "contract_type"}
    for label, value in label_pairs(root):
        field_ = names.get(label.lower())
        if field_ and not out[field_]:
            out[field_] = value
    return out


_SCHEMA = (
    "page_id long, url string, title string, heading string, n_links int, email string, phone string, whatsapp string, instagram string, facebook string, "
    "job_title string, company string, location string, posted_date string, n_words int"
)


def page_facts(pages: DataFrame) -> DataFrame:
    """One row a page of (page_id, url, html): title, first heading, contacts, posting, number of links and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                root = parse(r.html)
                titles, heads = root.find_all("title"), root.find_all("h1")
                c, j = contacts(root), job_posting(root)
                out.append(
                    (
                        r.page_id, r.url, titles[0].text() if titles else None, heads[0].text() if heads else None, len(root.find_all("a")),
                        c["email"], c["phone"], c["whatsapp"], c["instagram"], c["facebook"], j["title"], j["company"], j["location"], j["posted_date"], len(root.text().split()),
                    )
                )
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return pages.select("page_id", "url", "html").mapInPandas(run, _SCHEMA)
