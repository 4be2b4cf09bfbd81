"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from html.parser import HTMLParser

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=5):
    w = SPACES.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, percent):
    """docs: (id, text) rows, ids not null.  {id: component}."""
    sets = [(i, shingles(t)) for i, t in docs]
    edges = []
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                edges.append((a, b))
    return union_find({i for i, _ in docs}, edges)


def removed(docs, window=50):
    """docs: (id, text) rows.  A list of (id, words, flags of removed words), in their order."""
    words = [(i, SPACES.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((i, w, gone))
    return out


def kept_digest(w, gone):
    return hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def contamination(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        m = min(window, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[a : a + m]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                got = patterns.get(tuple(w[a : a + m]))
                if got:
                    found |= got
                    hit[a : a + m] = [True] * m
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


class Page(HTMLParser):
    """Visible text, title, language and links of well-formed pages, by the parser of the standard library."""

    BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol table tr article section header footer nav main aside blockquote pre form dl dt dd figure body html br hr".split())
    HIDDEN = {"script", "style", "noscript", "template", "head"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title, self.language, self.links = [], 0, "", False, "", []
        self.feed(page)
        self.close()
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\0"))
        self.text = "\n".join(x for x in lines if x)

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        self.hidden += tag in self.HIDDEN
        self.in_title = tag == "title"
        if tag == "html":
            self.language = values.get("lang") or ""
        if tag == "a" and "href" in values and not self.hidden:
            self.links.append(values["href"])
        if tag in self.BLOCKS:
            self.out.append("\0")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.in_title = False
        if tag in self.HIDDEN:
            self.out.append(" ")
        if tag in self.BLOCKS:
            self.out.append("\0")

    def handle_data(self, data):
        if self.in_title:
            self.title = " ".join((self.title + data).split())
        if not self.hidden:
            self.out.append(data)
