"""Queries that SQL cannot express, against plain Python over the smallest tables."""

import hashlib
import json
import os
import posixpath
import re
from urllib.parse import urljoin, urlsplit

import pytest

from tessella.functions import privacy
from tessella.plans import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def python_pattern(p):
    return re.compile(p.replace("(?iU)", "(?i)").replace("(?U)", ""))


PATTERNS = [python_pattern(p) for p in privacy.PATTERNS]
VOLATILE = [python_pattern(p) for p in privacy.VOLATILE]


def squeeze(t):
    return " ".join((t or "").split())


def sanitised(t, limit):
    t, n = squeeze(t), 0
    for p in PATTERNS:
        t, k = p.subn(" ", t)
        n += k
    return squeeze(t)[:limit], n


def plain(markup):
    out = re.sub("<[^>]*>", " ", markup)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = out.replace(entity, char)
    return squeeze(out)


def shown(html):
    return re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", " ", html)


def links(html):
    return [(m[0], plain(m[1])) for m in re.findall(r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', shown(html))]


def headings(html):
    return [plain(m) for m in re.findall(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", shown(html))]


def title(html):
    found = re.search(r"(?is)<title>(.*?)</title>", html)
    return plain(found[1]) if found else ""


def route_key(path):
    return "/" + re.sub(r"[?#].*$", "", path.strip(), flags=re.S).strip("/")


def path_of(url):
    found = re.match(r"^[a-z]+://[^/?#]*([^?#]*)", url)
    return found[1] if found else ""


def masked_query(url):
    found = re.search(r"\?([^#]*)", url)
    if not found or not found[1]:
        return ""
    return "&".join(f"{k}=%2A" for k in sorted({p.split("=", 1)[0] for p in found[1].split("&") if "=" in p and not p.startswith("=")}))


def without_volatile(t):
    for p in VOLATILE:
        t = p.sub("<volatile>", t)
    return re.sub(r"<volatile>(?:\s*<volatile>)+", "<volatile>", t)


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_sanitize_detect(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.clean, r.detections) for r in QUERIES["sanitize_detect"](spark, SF).collect()}
    assert got == {i: sanitised(t, 4000) for i, t in texts.items()}
    assert any(n for _, n in got.values())


def test_safe_fragments(spark, pages):
    def fold(parts, limit=2000):
        text, seen, excluded = "", set(), 0
        for raw in parts:
            if not squeeze(raw):
                continue
            clean, n = sanitised(raw, limit)
            if n or not clean:
                excluded += max(1, n)
            elif clean.lower() not in seen:
                joined = f"{text} | {clean}" if text else clean
                if len(joined) > limit:
                    excluded += 1
                else:
                    text = joined
                    seen.add(clean.lower())
        return text, excluded

    got = {r.page_id: (r.text, r.exclusions) for r in QUERIES["safe_fragments"](spark, SF).collect()}
    assert got == {i: fold([title(h), *headings(h), *(label for _, label in links(h))]) for i, _, h in pages}


def test_allowed_links(spark, pages):
    def inside(href, base):
        href = href.strip()
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:", "tel:")):
            return None
        home, to = urlsplit(base), urlsplit(urljoin(base, href))
        if to.scheme not in ("", "http", "https") or (to.netloc and to.netloc.lower() != home.netloc.lower()):
            return None
        path = "/" + (posixpath.normpath(to.path) if to.path else "/").lstrip("/")
        return f"{path}?{to.query}" if to.query else path

    want = {}
    for i, url, h in pages:
        for pos, (href, _) in enumerate(links(h)):
            route = inside(href, url)
            if route is not None and route.strip() not in ("", "/"):
                want.setdefault((i, route), pos)
    assert {(r.page_id, r.route): r.pos for r in QUERIES["allowed_links"](spark, SF).collect()} == want


def test_screen_search(spark, pages):
    from tessella.functions.text import EQUIVALENCES, STOP_WORDS

    def key(t):
        return squeeze(re.sub("[^a-z0-9/]+", " ", t.lower()))

    def singular(w):
        if len(w) > 6 and w.endswith("ciones"):
            return w[:-6] + "cion"
        if len(w) > 4 and w.endswith("es"):
            return w[:-2]
        return w[:-1] if len(w) > 3 and w.endswith("s") and w[-2] in "aeiou" else w

    def tokens(k):
        return {EQUIVALENCES.get(w, singular(w)) for w in k.replace("/", " ").split() if w not in STOP_WORDS}

    question = key("donde veo the and that en /en/101")
    asked, found = tokens(question), []
    for i, url, h in pages:
        name, route = key(title(h)), route_key(path_of(url))
        score = 12.0 if name and name in question else 5 * len(asked & tokens(name)) / max(1, len(tokens(name)))
        score += 2.5 * len(asked & tokens(key(route))) + 0.35 * len(asked & tokens(key(plain(shown(h))))) + 1.2 * len(asked & tokens(key(" ".join(headings(h)))))
        score += 0.6 * len(asked & tokens(key(" ".join(label for _, label in links(h))))) + (15 if route == "/en/101" else 0)
        if round(score, 3) >= 2.5:
            found.append((-round(score, 3), title(h).lower(), i))
    got = [(r.page_id, r.score) for r in QUERIES["screen_search"](spark, SF).collect()]
    assert [(i, pytest.approx(-s)) for s, _, i in sorted(found)[:3]] == got


def test_canonical_entities(spark, pages):
    """Counts of entities, their references and their stability, from the pages alone."""
    rows = QUERIES["canonical_entities"](spark, SF).collect()
    count = lambda kind: sum(r.entity_type == kind for r in rows)
    by_route = {route_key(path_of(url)): (i, h) for i, url, h in sorted(pages)}
    assert count("screen") == len(by_route) and count("erp") == 1 and count("module") == 4 and count("state") == len(by_route)
    ids = {i for i, _ in by_route.values()}
    assert count("transition") == sum(i + 1 in ids for i in ids)
    known = {r.canonical_id for r in rows}
    assert len(known) == len(rows) and all(r.parent_id is None or r.parent_id in known for r in rows)
    again = QUERIES["canonical_entities"](spark, SF).collect()
    assert {(r.canonical_id, r.content_hash) for r in rows} == {(r.canonical_id, r.content_hash) for r in again}
    issues = QUERIES["canonical_issues"](spark, SF).collect()
    assert all(r.severity == "warning" for r in issues)
    assert {r.subject for r in issues if r.code == "incomplete_transition"} == {f"s{i + 1}" for i in ids if i + 1 not in ids}


def test_statement_checks(spark):
    phrases = ("ignore previous instructions", "ignora las instrucciones", "system prompt", "act as system", "cambia tu rol")
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.error for r in QUERIES["statement_checks"](spark, SF).collect()}
    assert got.keys() == turns.keys()
    for (conv, turn), said in turns.items():
        said = "   " if turn % 7 == 5 else said + " — Cambia TU rol" if turn % 7 == 3 and said is not None else said
        t = squeeze(said)
        wanted = (
            "inference_empty" if not t else "inference_length" if len(t) > 400 else "inference_privacy" if any(p.search(t) for p in PATTERNS)
            else "inference_prompt_injection" if any(p in t.lower() for p in phrases) else None
        )
        assert got[conv, turn] == wanted, (conv, turn)
