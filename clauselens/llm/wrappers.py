"""Operator 6: main text by wrappers, union-free regular expressions over pages of a host.

A page is read as a tree; the children of an element are a token stream of elements and
texts. A wrapper holds for every element the union-free expression of its children: a
sequence of items that are required or optional, single or repeated, each an element
with its own expression or a text, fixed or a slot. The first page of a host is its
first wrapper; every further page is aligned with it (longest common subsequence of
the streams):

* neighbouring equal elements, and sequences of up to ``MAX_PERIOD`` elements and texts
  that repeat, are folded into a repeated group,
* an item on one side only becomes optional,
* texts that differ become a slot; texts that never differ stay fixed.

Wrappers merge the same way, so every task folds its pages of a host into one wrapper
first and only these are shuffled (in two steps, by host and salt, then by host): a
host with a third of all pages sends one small wrapper per task. Streams are aligned in linear
space: equal ends first, then between keys that are unique on both sides, then by longest
common subsequence where the rest is small, else by the next equal key.

The merged wrapper decides the text of the host's pages:

* which element holds the article: a semantic one (article, main) if the host has it, else the
  element whose slots hold most unlinked text;
* fixed texts in it, the same on all of at least ``MIN_PAGES`` different pages, are the
  host's (share lines, link bars), not the article's, if they are links or not in a block of
  prose (``PROSE``): blocks made of such texts only are left out;
* repeated elements in it that each name an author or a time are records of readers (comments
  under any class): they are left out on all pages, also where only one stands.

Pages are then read again; the blocks of that element make the text, without these and
without the elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments by tag, class, id or role (``EXCLUDED_*``). A header in the article
with a heading is the article's own; a form that holds the article or most of the page's text
is the page's frame, no form. A page without the wrapper's element is judged by its own wrapper.

Edge cases: a null or empty page has an empty text; a page cut off in a tag or a
reference keeps what is whole; a url without a host shares the wrapper of the empty
host; repeated rows give repeated results and count as one page of the host; nothing is
dropped or cut for length; only page_id, url and html are read. An empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import json

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare, written
from .markup import INLINE, RAW, Element, blocks, parse
from .urlfilter import host_of

MAX_PERIOD = 4
SALTS = 16
#: A text that is the same on all of this many different pages of a host is the host's.
MIN_PAGES = 5
#: Largest table of the exact alignment; beyond it streams are aligned by the next equal key.
MAX_TABLE = 250_000
#: Wrappers that a task holds before it passes them on.
HOSTS_HELD = 2000

EXCLUDED_TAGS = frozenset("head nav header footer aside form script style noscript iframe template svg canvas object button "
                          "select textarea title menu dialog xmp".split())
EXCLUDED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment comments reply replies "
    "disqus notice notices cookie cookies consent gdpr alert popup modal overlay share sharing social newsletter subscribe "
    "subscription signup login search pagination pager toolbar complementary contentinfo dialog discussion discussions "
    "response responses respond thread threads talkback guestbook shoutbox".split())
#: Beginnings of one-word names (cookiebar, commentlist) that say as much, and words that only look so.
EXCLUDED_STEMS = ("cookie", "comment", "advert", "newsletter", "breadcrumb")
OTHER_WORDS = frozenset("commentary commentaries".split())
#: Names and tags that a reader's record has and a part of an article has not.
RECORD_NAMES = frozenset("author user username avatar byline vcard date datetime time timestamp posted permalink".split())
RECORD_TAGS = frozenset("div section article li dd tr td blockquote".split())
#: Blocks of prose: what stands in them is the article's, even if it never changes, unless it is all links.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Parts of a name: before a word they say that it is meant of another element, after
#: it they say nothing more; and a header of these is the article's own.
OTHERS = frozenset("no not non has have with without hide hides hidden show shows".split())
PLACES = frozenset("container wrapper wrap box list area section block slot inner item items left right top bottom links".split())
OWN = frozenset("article entry post story content page main".split())


def _names_excluded(names) -> bool:
    """Whether a class, id or role is an excluded word, or ends with one."""
    for name in names:
        parts = name.split("-")
        while len(parts) > 1 and parts[-1] in PLACES:
            parts.pop()
        word = parts[-1]
        known = word in EXCLUDED_NAMES or (word.startswith(EXCLUDED_STEMS) and word not in OTHER_WORDS)
        if known and OTHERS.isdisjoint(parts) and not (
                parts[-1] == "header" and not OWN.isdisjoint(parts)):
            return True
    return False


def _has(e: Element, tags) -> bool:
    todo = list(e.children)
    while todo:
        c = todo.pop()
        if not isinstance(c, str):
            if c.tag in tags:
                return True
            todo += c.children
    return False


def page_tree(html: str | None) -> Element:
    """The tree of a page, in which a form that frames the page counts as a plain block: it holds
    the article, or most of the page's text."""
    root = parse(html)
    forms, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag == "form":
            forms.append(e)
        todo += [c for c in e.children if not isinstance(c, str)]
    if forms:
        size = lambda e: sum(map(len, blocks(e, lambda x, _: x is not e and x.tag != "form" and excluded(x))))
        whole = size(root)
        for e in forms:
            if _has(e, ("article", "main")) or (_has(e, HEADINGS | {"p"}) and 2 * size(e) > whole):
                e.tag, e.key = "div", ".".join(("div", *e.names))
    return root


def excluded(e: Element) -> bool:
    return e.tag in EXCLUDED_TAGS or (e.tag not in ("main", "body", "html") and _names_excluded(e.names))


# An item of a wrapper is a list [kind, key, optional, repeated, body]:
#   element: ["e", key, opt, rep, [items]], group: ["g", joined keys, opt, rep, [items]],
#   text: ["t", "#", opt, rep, [hash or None for a slot, plain characters, linked characters]].

def _fold(items: list) -> list:
    """Items with tandem repeats merged into repeated items or groups."""
    period = 1
    while period <= MAX_PERIOD:
        out: list = []
        i = 0
        while i < len(items):
            here = items[i:i + period]
            keys = [x[1] for x in here]
            if len(out) >= period and len(here) == period and not all(x[0] == "t" for x in here):
                last = out[-1]
                if period == 1:
                    if last[1] == keys[0] and last[0] == here[0][0]:
                        out[-1] = _merge_items(last, here[0], repeated=True)
                        i += 1
                        continue
                elif last[0] == "g" and last[1] == "|".join(keys):
                    out[-1] = _merge_items(last, ["g", last[1], 0, 1, here], repeated=True)
                    i += period
                    continue
                elif [x[1] for x in out[-period:]] == keys and len(set(keys)) > 1:
                    group = ["g", "|".join(keys), 0, 1, out[-period:]]
                    out[-period:] = [_merge_items(group, ["g", group[1], 0, 1, here], repeated=True)]
                    i += period
                    continue
            out.append(items[i])
            i += 1
        items = out
        period += 1
    return items


def _merge_items(a: list, b: list, repeated: bool = False) -> list:
    if a[0] == "t":
        x, y = a[4], b[4]
        body = [x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2]]
    else:
        body = align(a[4], b[4])
    return [a[0], a[1], a[2] | b[2], a[3] | b[3] | int(repeated), body]


def align(a: list, b: list) -> list:
    """The union-free expression that covers both item sequences."""
    if [x[1] for x in a] == [y[1] for y in b]:
        return [_merge_items(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in [*_common([x[1] for x in a], [y[1] for y in b]), (len(a), len(b))]:
        out += [[*z[:2], 1, *z[3:]] for z in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge_items(a[x], b[y]))
        i, j = x + 1, y + 1
    return _fold(out)


def _common(a: list, b: list) -> list:
    """Index pairs of a common subsequence of two key lists."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while n > i and m > j and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            pairs.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= MAX_TABLE:
            pairs += _longest(a, b, i, n, j, m)
            continue
        anchors = _anchors(a, b, i, n, j, m)
        if anchors:
            ends = [*anchors, (n, m)]
            pairs += anchors
            for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], ends):
                todo.append((x + 1, x2, y + 1, y2))
        else:
            pairs += _next_equal(a, b, i, n, j, m)
    return sorted(pairs)


def _longest(a, b, i0, n, j0, m) -> list:
    """Longest common subsequence by the full table."""
    best = [[0] * (m - j0 + 1) for _ in range(n - i0 + 1)]
    for i in range(n - 1, i0 - 1, -1):
        row, below = best[i - i0], best[i - i0 + 1]
        for j in range(m - 1, j0 - 1, -1):
            k = j - j0
            row[k] = below[k + 1] + 1 if a[i] == b[j] else max(below[k], row[k + 1])
    out, i, j = [], i0, j0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i - i0 + 1][j - j0] >= best[i - i0][j - j0 + 1]:
            i += 1
        else:
            j += 1
    return out


def _anchors(a, b, i, n, j, m) -> list:
    """Keys that stand once on both sides, in the longest order that both share."""
    once = []
    for seq, lo, hi in ((a, i, n), (b, j, m)):
        at: dict = {}
        for k in range(lo, hi):
            at[seq[k]] = k if seq[k] not in at else None
        once.append(at)
    both = sorted((k, once[1].get(key)) for key, k in once[0].items() if k is not None and once[1].get(key) is not None)
    ends, tops, back = [], [], {}
    for k, (_, y) in enumerate(both):                     # longest increasing sequence of places in b
        at = bisect.bisect_left(ends, y)
        back[k] = tops[at - 1] if at else None
        ends[at:at + 1], tops[at:at + 1] = [y], [k]
    out, k = [], tops[-1] if tops else None
    while k is not None:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def _next_equal(a, b, i, n, j, m) -> list:
    """Every item with the next equal one on the other side, if it is near."""
    places: dict = {}
    for k in range(j, m):
        places.setdefault(b[k], []).append(k)
    out = []
    for x in range(i, n):
        at = places.get(a[x], ())
        k = bisect.bisect_left(at, j)
        if k < len(at) and at[k] - j <= max(8, (m - j) // max(1, n - x)):
            out.append((x, at[k]))
            j = at[k] + 1
    return out


MAX_DEPTH = 60


def page_items(root: Element) -> list:
    """The expression of one page. Below ``MAX_DEPTH`` levels the streams are not told
    apart further: their texts count for the element at that level."""

    def of(e: Element, linked: bool, depth: int) -> list:
        items = []
        for c in e.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                if t:
                    items.append(["t", "#", 0, 0, [xxhash.xxh64_intdigest(t) >> 1, 0 if linked else len(t), len(t) if linked else 0]])
            elif c.tag in RAW:
                items.append(["e", c.key, 0, 0, []])
            elif depth >= MAX_DEPTH:
                t = " ".join(blocks(c, lambda *_: False))
                items.append(["t", "#", 0, 0, [None, 0 if linked else len(t), len(t) if linked else 0]])
            else:
                items.append(["e", c.key, 0, 0, of(c, linked or c.tag == "a", depth + 1)])
        return _fold(items)

    return of(root, False, 0)


def article_path(items: list, lift: bool = True) -> list:
    """Keys from the page down to the element that holds the article. With ``lift``,
    names do not exclude what holds a semantic element with more text than the best
    element else, nor, where nothing else has text, what holds most of the slots' text."""
    path, weight, semantic = _path(items, excluded)
    if semantic or not lift:
        return path
    by_tag = lambda e: e.tag in EXCLUDED_TAGS
    other, more, semantic = _path(items, by_tag)
    if semantic and more > weight:
        return other
    return path or _path(items, by_tag, slots=True)[0]


def _path(items: list, skip, slots: bool = False) -> tuple:
    """(path, its unlinked characters, whether it is semantic)"""
    semantic: list = []
    weights: list = []

    def usable(key: str) -> bool:
        tag, *names = key.split(".")
        e = Element(tag, tuple(names))
        return not skip(e)

    def walk(seq: list, path: list) -> tuple:
        """(plain, linked) characters of usable texts directly in blocks below."""
        plain = linked = 0
        for kind, key, _, _, body in seq:
            if kind == "t":
                if not slots or body[0] is None:
                    plain, linked = plain + body[1], linked + body[2]
            elif kind == "g":
                p, k = walk(body, path)
                plain, linked = plain + p, linked + k
            elif usable(key):
                here = path + [key]
                p, k = walk(body, here)
                tag = key.split(".")[0]
                if tag in ("article", "main") or "main" in key.replace("-", ".").split(".")[1:]:
                    semantic.append((tag == "article", p, here))
                weights.append((p - 2 * k, len(here), here))
                plain, linked = plain + p, linked + k
        return plain, linked

    walk(items, [])
    if semantic:
        best = max(semantic, key=lambda s: (s[0], s[1], [-ord(c) for c in "/".join(s[2])]))
        return best[2], best[1], True
    if not weights:
        return [], 0, False
    # The deepest element that still has nearly all of the best unlinked text.
    top = max(w for w, _, _ in weights)
    good = [(d, h) for w, d, h in weights if w > 0 and w >= 0.8 * top and h[-1].split(".")[0] not in ("p", "b", "span", "h1")]
    return (max(good, key=lambda x: (x[0], x[1]))[1], top, False) if good else ([], 0, False)


def find(root: Element, path: list) -> list:
    """The elements on a path, in page order."""
    level = [root]
    for key in path:
        level = [c for e in level for c in e.children if not isinstance(c, str) and c.key == key]
    return level


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split())) >> 1


def host_rules(wrapper: list) -> dict:
    """What a wrapper ``[page hashes, items]`` says of its pages: the path of the article, the fixed
    texts in it as [path, hash], and the paths of readers' records."""
    pages, items = wrapper
    path = article_path(items)
    level = items
    for key in path:
        level = [y for x in _open(level) if x[0] == "e" and x[1] == key for y in x[4]]
    fixed, records = set(), set()
    # (items, path, on every page)
    todo = [(level, "", True)] if path else []
    while todo:
        seq, at, always = todo.pop()
        for kind, key, optional, repeated, body in seq:
            here = always and not optional
            if kind == "g":
                todo.append(([[*x[:3], 1, *x[4:]] for x in body], at, here))
            elif kind == "e":
                if repeated and key.split(".")[0] in RECORD_TAGS and _names_someone(body):
                    records.add(f"{at}/{key}")
                todo.append((body, f"{at}/{key}", here))
            elif here and body[0] is not None and (not body[1] or _block_tag(at) not in PROSE):
                fixed.add((at, body[0]))
    return {"path": path, "records": sorted(records), "fixed": sorted(map(list, fixed)) if len(pages) >= MIN_PAGES else []}


def _block_tag(path: str) -> str:
    """The tag of the innermost block on a path."""
    tags = [key.split(".")[0] for key in path.split("/")]
    return next((t for t in reversed(tags) if t not in INLINE), "")


def _open(items: list) -> list:
    """The items with those of groups in place of the groups."""
    out = []
    for x in items:
        out += _open(x[4]) if x[0] == "g" else [x]
    return out


def _names_someone(items: list) -> bool:
    todo = list(items)
    while todo:
        kind, key, *_, body = todo.pop()
        if kind != "t":
            if kind == "e":
                tag, *names = key.split(".")
                if tag == "time" or any(not RECORD_NAMES.isdisjoint(n.split("-")) for n in names):
                    return True
            todo += body
    return False


def main_text(html: str | None, rules: dict | None) -> str:
    """Text of a page by the rules of its host's wrapper, or by its own."""
    root = page_tree(html)
    rules = rules or {}
    regions = find(root, rules["path"]) if rules.get("path") else []
    fixed, records = rules.get("fixed_set") or frozenset(), rules.get("record_set") or frozenset()
    if not regions:
        regions, fixed, records = find(root, article_path(page_items(root), not rules.get("path"))), frozenset(), frozenset()

    def text(e: Element) -> list:
        def skip(x, path):
            if x is e:
                return False
            if x.tag == "header" and not _names_excluded(x.names) and _has(x, HEADINGS):
                return False
            return excluded(x) or f"{path}/{x.key}" in records

        return blocks(e, skip, (lambda path, t: (path, text_hash(t)) in fixed) if fixed else None)

    return "\n".join(t for e in (regions or [root]) for t in text(e))


def read_rules(text: str | None) -> dict:
    """Rules from JSON, with sets for the look-ups."""
    rules = json.loads(text) if text else {}
    return rules | {"fixed_set": {(p, h) for p, h in rules.get("fixed", ())}, "record_set": set(rules.get("records", ()))}


def page_wrapper(html: str | None) -> list:
    """The wrapper ``[page hashes, items]`` of one page."""
    return [[xxhash.xxh64_intdigest(html or "") >> 1], page_items(page_tree(html))]


def merged(a: list, b: list) -> list:
    """Both wrappers as one; of the hashes of different pages ``MIN_PAGES`` are kept, the smallest."""
    return [sorted({*a[0], *b[0]})[:MIN_PAGES], align(a[1], b[1])]


def _folded(batches):
    """(host, salt, wrapper as JSON): the pages of a task, one wrapper per host."""
    held: dict = {}

    def passed_on():
        hosts = sorted(held)
        out = pa.record_batch({"host": pa.array(hosts, pa.string()),
                               "salt": pa.array([xxhash.xxh32_intdigest(json.dumps(held[h])) % SALTS for h in hosts], pa.int64()),
                               "wrapper": pa.array([json.dumps(held[h]) for h in hosts], pa.string())})
        held.clear()
        return out

    for b in batches:
        pages = sorted(zip(b.column("host").to_pylist(), b.column("html").to_pylist()), key=lambda x: (x[0], x[1] or ""))
        last = None
        for host, page in pages:
            if (host, page) == last:                      # repeated rows say nothing more
                continue
            last = (host, page)
            own = page_wrapper(page)
            if own[1]:
                held[host] = merged(held[host], own) if host in held else own
            if len(held) >= HOSTS_HELD:
                yield passed_on()
    if held:
        yield passed_on()


def _merged(frame: pd.DataFrame) -> list:
    """All wrappers of a group as one: neighbours of the sorted list in rounds, as a tree."""
    level = [json.loads(w) for w in sorted(set(frame["wrapper"]))]
    while len(level) > 1:
        level = [merged(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: the wrapper of every host with a page, as JSON."""
    src = pages.select(host_of(F.col("url")).alias("host"), "html")

    def by_salt(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(_merged(frame))]})

    parts = map_batches(src, _folded, "host string, salt long, wrapper string")
    return (parts.groupBy("host", "salt").applyInPandas(by_salt, "host string, wrapper string")
            .groupBy("host").applyInPandas(by_salt, "host string, wrapper string"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)

    def rules(batches):
        for b in batches:
            yield pa.record_batch([b.column("host"), pa.array([json.dumps(host_rules(json.loads(w)))
                                                               for w in b.column("wrapper").to_pylist()], pa.string())],
                                  names=["w_host", "rules"])

    found = written(map_batches(host_wrappers(pages), rules, "w_host string, rules string"), "wrappers")

    def run(batches):
        known: dict = {}
        for b in batches:
            out = []
            for page, text in zip(b.column("html").to_pylist(), b.column("rules").to_pylist()):
                if text not in known:
                    if len(known) >= HOSTS_HELD:
                        known.clear()
                    known[text] = read_rules(text)
                out.append(main_text(page, known[text]))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                   pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    src = src.join(found, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "rules")
    return map_batches(src, run, "page_id long, url string, text string, n_chars long")
