"""Main text of web pages by inferred wrappers.

Pages of one host come from few templates. A wrapper is a union-free regular expression over tags and
text: from a bounded sample of a host's pages, token streams are aligned one after another. Equal
neighbours fold into repeated groups, what only some pages have becomes optional, and text becomes a
slot. The article is found from marked containers or from where the text lies; parts of it that are
menus, adverts, notices, forms or comments are told by their tags, roles and class words. A class
word never counts against the article itself, what stands around it, or a part with its headline or
most of its text. Every page is matched with its host's wrapper.

The sample only aligns. A text that stands in one slot of several sampled pages is template if it
stands there on `most` percent of all pages of the host, which are counted; and only blocks with that
very text are left out, on pages that say something else as well.

Defined cases: a null or empty page has an empty text; a null or odd URL belongs to the host "";
broken and unclosed markup is read as far as it goes; a host with one page has that page as its
wrapper; rows that share an id are extracted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerproof.llm.common import staged, table


@dataclass(frozen=True)
class Options:
    """`sample` different pages per host (smallest digests) are aligned, with repeated groups of up
    to `group` items. A text that stands in one slot of `constant` of them may be template, and is if
    `most` percent of the host's pages hold it there. Wrappers, and the digests of the sample, are
    broadcast up to `broadcast` bytes in all, and joined by a shuffle beyond that."""

    sample: int = 12
    group: int = 12
    constant: int = 5
    most: int = 90
    broadcast: int = 32 << 20


DEFAULT = Options()
ROW_BYTES = 100  # of a digest and a host, about

# Elements of HTML by their part in the text, and words that name page furniture.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby "
    "rb rp rt s samp small span strike strong sub sup time tt u var wbr "
    # Formulas, drawings and embedded objects stand within a text.
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mtable mtr mtd mstyle semantics annotation svg g text tspan path object".split()
)
BLOCKS = frozenset(
    "p li dt dd h1 h2 h3 h4 h5 h6 tr td th caption figcaption legend option pre hr address".split()
)
RAW = frozenset("script style title textarea noscript template iframe xmp".split())
VOID = frozenset("area base col embed input link meta param source track".split())
FURNITURE_TAGS = frozenset(
    "nav footer aside form menu dialog button select head fieldset canvas audio video".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars side ad ads adv advert "
    "adverts advertisement advertising adbox adslot banner promo promotion promoted sponsor sponsored "
    "cookie cookies notice notices consent gdpr popup modal overlay comment comments commentlist "
    "disqus reply replies respond discussion share sharing social related recommended breadcrumb "
    "breadcrumbs pager pagination subscribe subscription newsletter signup login search widget "
    "widgets toolbar copyright legal skip".split()
)
MAIN_TAGS = ("article", "main")
MAIN_WORDS = frozenset("article content post entry story main body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)"
    r"(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# Pages as units


class Paths:
    """The places of containers as numbers: a place is the one around it and the container's key.
    Numbers grow inwards, and what is asked about a place is kept beside it."""

    def __init__(self):
        self.parent, self.key, self.names = [0], [""], [""]
        self.inside, self.barred, self.worded = [False], [False], [False]
        self.child: dict[tuple[int, str], int] = {}

    def at(self, parent: int, key: str) -> int:
        found = self.child.get((parent, key))
        if found is None:
            found = self.child[parent, key] = len(self.key)
            name = key.partition("|")[0]
            inside = self.inside[parent]
            self.parent.append(parent)
            self.key.append(key)
            self.names.append(name)
            self.inside.append(inside or name in MAIN_TAGS)
            self.barred.append(self.barred[parent] or barred(key, inside))
            self.worded.append(worded(key, inside))
        return found

    def keys(self, place: int) -> list[str]:
        """The keys from the outermost container to this one."""
        out = []
        while place:
            out.append(self.key[place])
            place = self.parent[place]
        return out[::-1]

    def find(self, keys: list[str]) -> int | None:
        place = 0
        for key in keys:
            place = self.child.get((place, key))
            if place is None:
                return None
        return place


@dataclass
class Unit:
    """A container's start or end, or a block of text. `place` is that of the containers around it."""

    key: str
    place: int
    text: str | None = None
    links: int = 0


def container_key(name: str, rest: str) -> str:
    """The tag with its classes, id and role, which tell templates apart."""
    found = [name]
    if "=" in rest or "hidden" in rest:
        for kind, *values in ATTRIBUTE.findall(rest):
            value = " ".join("".join(values).split())
            found.append(f"{kind.lower()}={re.sub('[0-9]+', '0', value)}")
    return "|".join(found)


def units_of(page: str, paths: Paths | None = None) -> list[Unit]:
    """The containers and text blocks of a page in order."""
    paths = paths or Paths()
    out: list[Unit] = []
    stack: list[int] = [0]
    open_names: Counter[str] = Counter()
    text: list[str] = []
    links = depth = 0
    block = ""

    def flush():
        nonlocal links
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            out.append(Unit(block, stack[-1], words, links))
        text.clear()
        links = 0

    def closed() -> str:
        place = stack.pop()
        out.append(Unit("/" + paths.key[place], stack[-1]))
        open_names[paths.names[place]] -= 1
        return paths.names[place]

    def say(piece: str):
        nonlocal links
        text.append(piece)
        if depth:
            links += len(piece)

    place = 0
    while True:
        hit = TOKEN.search(page, place)
        if hit is None:
            say(page[place:])
            break
        if hit.start() > place:
            say(page[place:hit.start()])
        place = hit.end()
        name = (hit["name"] or "").lower()
        if not name or name in VOID:
            continue
        if hit["close"]:
            if name == "a":
                depth = 0
            if name in INLINE:
                continue
            flush()
            block = ""
            if name in BLOCKS:
                continue
            while open_names[name]:
                if closed() == name:
                    break
        elif name in RAW:
            if not hit["rest"].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, place)
                place = end.end() if end else len(page)
        elif name in INLINE:
            if name == "a":
                depth = 1
            elif name == "br":
                say(" ")
        else:
            flush()
            depth = 0
            if name in BLOCKS:
                block = name
            else:
                block = ""
                key = container_key(name, hit["rest"])
                out.append(Unit(key, stack[-1]))
                stack.append(paths.at(stack[-1], key))
                open_names[name] += 1
    flush()
    while len(stack) > 1:
        closed()
    return out


# Wrappers


@dataclass
class Item:
    """A part of a wrapper: a tag, a slot for text, or a group of items. `times` is whether it may
    stand more than once in a row."""

    key: str
    place: int = 0
    optional: bool = False
    times: bool = False
    body: list[Item] | None = None
    pages: int = 1
    texts: Counter = field(default_factory=Counter)
    chars: int = 0
    links: int = 0
    slot: bool = False

    def shape(self):
        return (self.key, tuple(i.shape() for i in self.body) if self.body else ())


def item_of(unit: Unit) -> Item:
    if unit.text is None:
        return Item(unit.key, unit.place)
    return Item(
        "#" + unit.key, unit.place, texts=Counter([unit.text]), chars=len(unit.text), links=unit.links,
        slot=True,
    )


def joined(a: Item, b: Item, pages: bool) -> Item:
    """Two occurrences of one item as one: of two pages, or of one page (a repetition)."""
    out = Item(
        a.key, a.place, a.optional or b.optional, a.times or b.times,
        aligned(a.body, b.body, pages) if a.body and b.body else a.body or b.body,
        a.pages + b.pages if pages else max(a.pages, b.pages),
        a.texts + b.texts if pages and not (a.times or b.times) else Counter(), a.chars + b.chars,
        a.links + b.links, a.slot,
    )
    if not pages:
        out.times = True
    return out


def folded(items: list[Item], options: Options = DEFAULT) -> list[Item]:
    """Equal neighbours as one repeated item; equal neighbouring groups as one repeated group."""
    out = list(items)
    for size in range(1, options.group + 1):
        done: list[Item] = []
        k = 0
        while k < len(out):
            group = out[k:k + size]
            shapes = [i.shape() for i in group]
            balanced = size == 1 or _balanced(group)
            end = k + size
            if len(group) == size and balanced and (size > 1 or group[0].slot or group[0].body):
                merged = group
                while [i.shape() for i in out[end:end + size]] == shapes:
                    merged = [joined(a, b, False) if (a.slot or a.body) else a
                              for a, b in zip(merged, out[end:end + size])]
                    if size > 1:
                        for i, old in zip(merged, group):
                            i.times = old.times or (i.times and bool(old.body))
                    end += size
                if end > k + size:
                    done.append(merged[0] if size == 1 else Item(
                        "(" + group[0].key, group[0].place, body=merged, times=True,
                        pages=merged[0].pages,
                    ))
                    k = end
                    continue
            done.append(out[k])
            k += 1
        out = done
    return out


def _balanced(group: list[Item]) -> bool:
    """Whether every container that starts in a group ends in it."""
    open_keys: list[str] = []
    for i in group:
        if i.slot or i.body:
            continue
        if i.key.startswith("/"):
            if not open_keys or open_keys.pop() != i.key[1:]:
                return False
        else:
            open_keys.append(i.key)
    return not open_keys


def aligned(a: list[Item], b: list[Item], pages: bool = True) -> list[Item]:
    """The items of both lists in order. At a mismatch each side is searched for the other's next
    item; the shorter way wins, and what is passed over becomes optional."""
    where: dict[str, list[int]] = {}
    for k, item in enumerate(b):
        where.setdefault(item.key, []).append(k)
    ahead: dict[str, list[int]] = {}
    for k, item in enumerate(a):
        ahead.setdefault(item.key, []).append(k)
    out: list[Item] = []
    i = j = 0

    def passed(item: Item) -> Item:
        item.optional = True
        return item

    def following(places: dict[str, list[int]], key: str, start: int) -> int | None:
        return next((k for k in places.get(key, ()) if k >= start), None)

    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            out.append(joined(a[i], b[j], pages))
            i, j = i + 1, j + 1
            continue
        x, y = following(ahead, b[j].key, i), following(where, a[i].key, j)
        if x is not None and (y is None or x - i <= y - j):
            out += map(passed, a[i:x])
            i = x
        elif y is not None:
            out += map(passed, b[j:y])
            j = y
        else:
            out += [passed(a[i]), passed(b[j])]
            i, j = i + 1, j + 1
    return out + [passed(x) for x in a[i:]] + [passed(x) for x in b[j:]]


def barred(key: str, inside: bool) -> bool:
    """Whether a container's tag or role says that it is no article. `inside`: it stands in one."""
    name, *attributes = key.split("|")
    if name in FURNITURE_TAGS or name == "header" and not inside:
        return True
    pairs = (a.partition("=") for a in attributes)
    return any(
        kind == "hidden" or kind == "role" and value.lower() in FURNITURE_ROLES
        for kind, _, value in pairs
    )


def worded(key: str, inside: bool) -> bool:
    """Whether a container's classes or id name furniture. An article that stands in no other one is
    not judged by them."""
    name, *attributes = key.split("|")
    if name in ("html", "body", "main") or name == "article" and not inside:
        return False
    return any(
        a.startswith(("class=", "id=")) and any(w.lower() in FURNITURE_WORDS for w in WORDS.findall(a[3:]))
        for a in attributes
    )


def subtotals(paths: Paths, sizes: Counter) -> list[int]:
    """The characters in each place and the places in it."""
    total = [0] * len(paths.key)
    for place, size in sizes.items():
        total[place] += size
    for place in range(len(total) - 1, 0, -1):
        total[paths.parent[place]] += total[place]
    return total


def main_places(paths: Paths, sizes: Counter) -> list[int]:
    """Where the article is, from the places of text and their sizes: marked containers, else the
    container named like content, else the deepest one with most of the text. Containers with class
    words of furniture are left aside where others exist."""
    aside = [False] * len(paths.key)
    for place in range(1, len(aside)):
        aside[place] = aside[paths.parent[place]] or paths.worded[place]
    free = Counter({p: n for p, n in sizes.items() if not paths.barred[p]})
    total = subtotals(paths, free)
    for tag in MAIN_TAGS:
        marked = [
            p for p in range(1, len(aside)) if total[p] and paths.names[p] == tag
            and not (paths.inside[paths.parent[p]] and _within(paths, p, tag))
        ]
        plain = [p for p in marked if not aside[p]]
        if plain:
            return plain
        if marked:
            return [max(marked, key=lambda p: (total[p], -p))]
    clear = Counter({p: n for p, n in free.items() if not aside[p]})
    total = subtotals(paths, clear or free)
    held = [p for p in range(len(total)) if total[p]] or [0]
    named = [
        p for p in held if p and total[p] * 2 >= total[0] and any(
            w.lower() in MAIN_WORDS for part in paths.key[p].split("|")[1:]
            for w in WORDS.findall(part.partition("=")[2])
        )
    ]
    rich = [p for p in held if total[p] * 10 >= total[0] * 8]
    return [max(named or rich)]


def _within(paths: Paths, place: int, tag: str) -> bool:
    """Whether a place stands in a container of this tag."""
    place = paths.parent[place]
    while place and paths.names[place] != tag:
        place = paths.parent[place]
    return place != 0


def kept_places(
    paths: Paths, main: list[int], sizes: Counter, headlines: set[int], known: dict[int, bool],
) -> tuple[list[bool], dict[int, bool]]:
    """Whether text at each place belongs to the article, and for containers in it with class words
    whether they do all the same: those with the headline or most of the text. `known` verdicts go
    before those of this page."""
    total = subtotals(paths, sizes)
    headline = subtotals(paths, Counter(dict.fromkeys(headlines, 1)))
    around: set[int] = set()
    for place in main:
        while place not in around:
            around.add(place)
            place = paths.parent[place]
    inside, kept, verdicts = [False] * len(total), [False] * len(total), {}
    whole = max((total[p] for p in main), default=0)
    for place in range(len(total)):
        parent, start = paths.parent[place], place in main
        inside[place] = start or bool(place) and inside[parent]
        kept[place] = inside[place] and (start or kept[parent]) and not paths.barred[place]
        if kept[place] and paths.worded[place] and place not in around:
            own = bool(headline[place]) or total[place] * 2 > whole
            verdicts[place] = kept[place] = known.get(place, own)
    return kept, verdicts


def inferred(pages: list[str], options: Options = DEFAULT) -> dict:
    """The wrapper of the pages of one host: where the article is, which containers in it with class
    words belong to it, the items, and texts that may be template.

    The role of a slot: 1 for text, 0 for lists of links, 2 + k where text k may be template.
    """
    paths = Paths()
    streams = {}
    for page in pages:
        units = units_of(page, paths)
        streams.setdefault(tuple((u.key, u.text) for u in units), units)  # copies count once
    wrapper: list[Item] = []
    for k, units in enumerate(streams.values()):
        items = folded([item_of(u) for u in units], options)
        wrapper = items if k == 0 else folded(aligned(wrapper, items), options)
    sizes, headlines = Counter(), set()
    for units in streams.values():
        measure(units, sizes, headlines)
    main = main_places(paths, sizes)
    kept, verdicts = kept_places(paths, main, sizes, headlines, {})
    marked = any(paths.names[p] in MAIN_TAGS for p in main)
    constant: list[str] = []

    def role(i: Item) -> int:
        text, n = i.texts.most_common(1)[0] if i.texts else ("", 0)
        if n >= options.constant and kept[i.place]:
            constant.append(text)
            return 1 + len(constant)
        return int(marked or not (i.key == "#li" and i.times and i.links * 10 >= i.chars * 9))

    def plain(items):
        return [
            [i.key, int(i.optional), int(i.times), role(i) if i.slot else -1,
             plain(i.body) if i.body else None]
            for i in items
        ]

    return {
        "main": [paths.keys(p) for p in main], "items": plain(wrapper), "constant": constant,
        "worded": [[paths.keys(p), v] for p, v in verdicts.items()],
    }


def measure(units: list[Unit], sizes: Counter, headlines: set[int]) -> None:
    """Add up the characters per place, and note the places of headlines."""
    for u in units:
        if u.text is not None:
            sizes[u.place] += len(u.text)
            if u.key == "h1":
                headlines.add(u.place)


def matched(items: list, units: list[Unit]) -> list[int | None]:
    """The role of each unit by the wrapper; None where it does not fit."""
    keys = ["#" + u.key if u.text is not None else u.key for u in units]
    roles: list[int | None] = [None] * len(units)
    where: dict[str, list[int]] = {}
    for k, key in enumerate(keys):
        where.setdefault(key, []).append(k)

    def first(item):
        return first(item[4][0]) if item[4] else item[0]

    def run(items, at: int, nested: bool) -> int:
        for item in items:
            key, optional, times, role, body = item
            start = first(item)
            if at < len(keys) and keys[at] != start and not optional and not nested:
                # Units that the wrapper does not know stand before this one.
                later = next((k for k in where.get(start, ()) if k >= at), None)
                if later is not None and (start[0] != "#" or later - at <= 3):
                    at = later
            while at < len(keys) and keys[at] == start:
                if body:
                    after = run(body, at, True)
                    if after == at:
                        break
                    at = after
                else:
                    roles[at] = role
                    at += 1
                if not times:
                    break
        return at

    run(items, 0, False)
    return roles


def judged(page: str | None, wrapper: dict | None) -> list[tuple[str, int | None]]:
    """The blocks of a page's article, each with its text and the role of its slot."""
    paths = Paths()
    units = units_of(page or "", paths)
    wrapper = wrapper or {"main": [], "items": [], "worded": []}
    sizes, headlines = Counter(), set()
    measure(units, sizes, headlines)
    main = [p for m in wrapper["main"] if (p := paths.find(m)) is not None]
    found = subtotals(paths, sizes)
    if not any(found[p] for p in main):
        main = main_places(paths, sizes)
    known = {p: v for keys, v in wrapper["worded"] if (p := paths.find(keys)) is not None}
    kept, _ = kept_places(paths, main, sizes, headlines, known)
    roles = matched(wrapper["items"], units)
    return [
        (u.text, role) for u, role in zip(units, roles)
        if u.text is not None and role != 0 and kept[u.place]
    ]


def template_texts(blocks: list[tuple[str, int | None]], wrapper: dict | None) -> list[int]:
    """Which of the wrapper's texts that may be template stand in their slots."""
    return [
        role - 2 for text, role in blocks
        if role is not None and role >= 2 and text == wrapper["constant"][role - 2]
    ]


def extracted(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page, blocks joined by line breaks. Texts that the wrapper has as
    `confirmed` are left out (all that may be template, if it doesn't say), unless nothing else is
    there."""
    blocks = judged(page, wrapper)
    out = set(template_texts(blocks, wrapper))
    if wrapper and "confirmed" in wrapper:
        out &= set(wrapper["confirmed"])
    left = [
        text for text, role in blocks
        if not (role and role - 2 in out and text == wrapper["constant"][role - 2])
    ]
    return "\n".join(left or [text for text, _ in blocks])


# Spark


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(host, "^.*@", ""))


def host_wrappers(pages: DataFrame, url: str, html: str, options: Options) -> DataFrame:
    """`host, wrapper` (JSON) and `n_constant` of each host."""
    rows = pages.select(
        host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.md5("html")))
    order = Window.partitionBy("host").orderBy("digest")
    chosen = staged(rows.select("host", "digest").distinct().withColumn(
        "n", F.row_number().over(order)
    ).where(F.col("n") <= options.sample).select("host", "digest"))
    # Few hosts: their sample reaches the pages, and the pages are not shuffled. Copies of a page
    # come down to one in each task.
    few = chosen.count() * ROW_BYTES <= options.broadcast
    sample = rows.join(
        F.broadcast(chosen) if few else chosen, ["host", "digest"]
    ).groupBy("host", "digest").agg(F.any_value("html").alias("html"))

    def infer(key, group: pd.DataFrame) -> pd.DataFrame:
        found = inferred(sorted(group["html"].tolist()), options)
        return pd.DataFrame({
            "host": [key[0]], "wrapper": [json.dumps(found)], "n_constant": [len(found["constant"])]
        })

    return sample.groupBy("host").applyInPandas(
        infer, "host string, wrapper string, n_constant long"
    )


def confirmed_texts(pages: DataFrame, wrappers: DataFrame, options: Options) -> DataFrame:
    """`host, confirmed`: the texts that enough of all pages of a host hold. `pages` has
    `host, html`; tasks count before anything is shuffled."""

    def run(parts):
        counts = Counter()

        def handed():
            keys = list(counts)
            return pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()),
                "text": pa.array([k[1] for k in keys], pa.int64()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            })

        for part in parts:
            for host, page, wrapper in zip(*part.columns):
                host, wrapper = host.as_py(), _read(wrapper.as_py())
                counts[host, -1] += 1
                for k in set(template_texts(judged(page.as_py(), wrapper), wrapper)):
                    counts[host, k] += 1
                if len(counts) > 100_000:
                    yield handed()
                    counts.clear()
        yield handed()

    counted = pages.join(wrappers.where("n_constant > 0"), "host").select(
        "host", "html", "wrapper"
    ).mapInArrow(run, "host string, text long, n long").groupBy("host", "text").agg(
        F.sum("n").alias("n")
    )
    # As many rows per host as its wrapper has such texts.
    return counted.groupBy("host").agg(
        F.max(F.when(F.col("text") < 0, F.col("n"))).alias("pages"),
        F.collect_list(F.when(F.col("text") >= 0, F.struct("text", "n"))).alias("texts"),
    ).select("host", F.transform(
        F.filter("texts", lambda t: t["n"] * 100 >= F.col("pages") * options.most),
        lambda t: t["text"],
    ).alias("confirmed"))


@lru_cache(maxsize=256)
def _read(wrapper: str | None) -> dict | None:
    return json.loads(wrapper) if wrapper else None


def _wrapper(cell) -> dict | None:
    return _read(cell.as_py())


def main_texts(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    options: Options = DEFAULT,
) -> DataFrame:
    """`page_id, url, text` of every page."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    wrappers = staged(host_wrappers(pages, url, html, options))
    held = wrappers.agg(F.sum(F.length("wrapper") + F.length("host")).alias("n")).first()["n"] or 0

    def sized(found: DataFrame) -> DataFrame:
        return F.broadcast(found) if held <= options.broadcast else found

    confirmed = staged(confirmed_texts(rows.select("host", "html"), sized(wrappers), options))
    known = sized(wrappers.join(confirmed, "host", "left").drop("n_constant"))
    kind = dict(rows.dtypes)["page_id"]

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 500):
                some = part.slice(start, 500)
                texts = [
                    extracted(h.as_py(), w and w | {"confirmed": c.as_py() or []})
                    for h, w, c in zip(some.column(2), map(_wrapper, some.column(3)), some.column(4))
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"],
                )

    return rows.join(known, "host", "left").select(
        "page_id", "url", "html", "wrapper", "confirmed"
    ).mapInArrow(run, f"page_id {kind}, url string, text string")


def op6_inferred_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


# For pages of the one template that the given tables hold.
SQL = {"op6_inferred_wrappers": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages
), blocks AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_replace(regexp_replace(
    x, '</?(b|i|em|strong|a)(\s[^>]*)?>', '', 'g'), '<br>', ' ', 'g'), '</?(p|h1)>')) AS t,
    unnest(range(len(regexp_split_to_array(regexp_replace(regexp_replace(
    x, '</?(b|i|em|strong|a)(\s[^>]*)?>', '', 'g'), '<br>', ' ', 'g'), '</?(p|h1)>')))) AS k FROM a
), plain AS (
  SELECT page_id, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
  FROM blocks
), joined AS (
  SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS text FROM plain WHERE t <> '' GROUP BY page_id
)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars
FROM a LEFT JOIN joined USING (page_id)
"""}

QUERIES = {"op6_inferred_wrappers": op6_inferred_wrappers}
