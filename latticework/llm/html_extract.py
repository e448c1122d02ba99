"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

1. A page becomes a stream of block tags and text places. Within a page, runs of equal groups are
   squares and fold into a repeated group.
2. Pages of a host with the same folded stream are counted as one (partial aggregation first, so a
   host with a third of all pages is as many rows as it has layouts). The streams of a host are
   aligned, ``FAN`` at a time over a tree of rounds, since a wrapper is itself a stream; a mismatch
   becomes an optional group, a group on one side that repeats on the other a repeated group, and what
   that leaves side by side folds again. Streams too long to be aligned with each other (``ALIGN`` pairs of
   symbols) stay wrappers of their own, of which a host may have several.
3. Each page is matched against its host's wrappers; every text gets its place. A match always exists,
   since a wrapper takes in the streams it was inferred from; it is found greedily or else by following all
   ways at once.
4. Text against text: a place is a slot where pages differ, and holds template text where they agree. A
   text that stands at the same place on half of the pages that have the place, on a fifth of the host's
   and on ``REPEATED`` at least is template text, and no page's own. Pages of equal texts count once.
5. The text of slots is content, unless the place is outside the article or main element of a host that
   has one, or in menus, headers, footers, sidebars, notices, adverts, forms or reader comments, known by
   their elements and names.

Edge cases: null html is the empty page; pages without url share the host ''; rows that repeat a
page_id are extracted each; a page without content gives the empty string; an empty table no rows;
other columns are not read, whatever their names. Pages of hosts with few pages have no template text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, tidy, tuned

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that do not break a block, elements without content, elements and names
#: that hold no article text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset head title".split())
NAMES = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN = frozenset("article main".split())
#: Elements whose end tag may be omitted, and the open ones that a new one ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TEXT = "#"
#: Streams that one task aligns, pairs of symbols that one alignment may compare, and distinct pages of
#: a host that have to hold a text at a place for it to be template text.
FAN, ALIGN, REPEATED = 64, 4_000_000, 3
#: Words of class, id and role that a symbol keeps: those that tell content from the rest.
WORDS = NAMES | MAIN


def tokens(page: str | None) -> tuple[list[str], list[str]]:
    """Symbols of the page, and the text at each TEXT symbol. ``<name words`` opens, ``/name`` closes."""
    page, at = page or "", 0
    symbols: list[str] = []
    texts: list[str] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                symbols.append(TEXT)
                texts.append(text)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pending.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        flush()
        if m["end"]:
            symbols.append("/" + name)
        else:
            words = set()
            for _, a, b, c in _ATTR.findall(m["attrs"] or ""):
                words.update(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower()))
            symbols.append(" ".join(["<" + name, *sorted(words & WORDS)]))
    if at < len(page):
        pending.append(entities.unescape(page[at:]))
    flush()
    return symbols, texts


# -- wrappers: lists of symbols, ["+", [...]] for a repeated group and ["?", [...]] for an optional one


def fold(items: list, ways: int = 8) -> list:
    """Squares: two or more equal neighbouring groups become one repeated group.

    A group may be of any length; it is looked for where its first item occurs next, ``ways`` times.
    """
    changed = True
    while changed:
        changed, out, i = False, [], 0
        keys = [x if isinstance(x, str) else json.dumps(x) for x in items]
        after, seen = [0] * len(keys), {}
        for j in range(len(keys) - 1, -1, -1):
            after[j] = seen.get(keys[j], 0)
            seen[keys[j]] = j
        while i < len(items):
            j, n, size = after[i], 1, 0
            for _ in range(ways):
                if not j or 2 * j - i > len(items):
                    break
                if keys[i:j] == keys[j : 2 * j - i]:
                    size = j - i
                    break
                j = after[j]
            while size and keys[i + n * size : i + (n + 1) * size] == keys[i : i + size]:
                n += 1
            if n > 1:
                out.append(items[i] if size == 1 and isinstance(items[i], list) else ["+", items[i : i + size]])
                i += n * size
                changed = True
            else:
                out.append(items[i])
                i += 1
        items = out
    return _absorb(items, items)


def _absorb(items: list, other: list) -> list:
    """Single occurrences of a group that is repeated in ``other`` count as repeated."""
    for group in {json.dumps(x[1]): x[1] for x in other if isinstance(x, list) and x[0] == "+"}.values():
        out, i, size = [], 0, len(group)
        while i < len(items):
            if items[i : i + size] == group:
                if not (out and out[-1] == ["+", group]):
                    out.append(["+", group])
                i += size
            elif out and items[i] == ["+", group] == out[-1]:
                i += 1
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers."""
    a, b = _absorb(a, b), _absorb(b, a)
    if a == b:
        return a
    strip = lambda x: json.dumps(x[1:] if isinstance(x, list) and x[0] == "?" else [[x]])
    left, right, out = [strip(x) for x in a], [strip(x) for x in b], []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [x if isinstance(x, list) and x[0] == "?" else y for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        one, two = a[i:j], b[k:m]
        if len(one) == len(two) == 1 and isinstance(one[0], list) and isinstance(two[0], list) and one[0][0] == two[0][0] and one[0][1][0] == two[0][1][0]:
            out.append([one[0][0], align(one[0][1], two[0][1])])
            continue
        for part in (one, two):
            if len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?":
                out.append(part[0])
            elif part:
                out.append(["?", part])
    return fold(out)


def infer(streams: list[list]) -> list:
    """One wrapper for all streams, aligned in the given order."""
    wrapper = streams[0]
    for stream in streams[1:]:
        wrapper = align(wrapper, stream)
    return wrapper


def infer_all(streams: list[list]) -> list[list]:
    """Wrappers that take in all streams in the given order; one, unless some are too long to be aligned."""
    out: list[list] = []
    for stream in streams:
        fits = [i for i, w in enumerate(out) if len(w) * len(stream) <= ALIGN]
        if fits:
            out[fits[0]] = align(out[fits[0]], stream)
        else:
            out.append(stream)
    return out


class Region:
    """The open elements while walking over symbols."""

    def __init__(self, has_main: bool):
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.has_main = has_main

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name

    def see(self, symbol: str) -> None:
        if symbol[0] == "<":
            name, *words = symbol[1:].split(" ")
            if name in VOID:
                return
            while self.stack and self.stack[-1][0] in _CLOSES.get(name, ()):
                self._pop()
            _, main, outside = self.stack[-1] if self.stack else ("", False, False)
            main = main or name in MAIN or "main" in words and name in ("div", "section", "td")
            bad = name in OUTSIDE and not (name == "header" and main) or name not in ("html", "body", "article", "main") and not NAMES.isdisjoint(words)
            self.stack.append((name, main, outside or bad))
            self.open[name] += 1
        elif symbol[0] == "/":
            if self.open[symbol[1:]]:
                while self._pop() != symbol[1:]:
                    pass

    def content(self) -> bool:
        _, main, outside = self.stack[-1] if self.stack else ("", False, False)
        return not outside and (main or not self.has_main)


def _flat(items: list):
    for x in items:
        if isinstance(x, list):
            yield from _flat(x[1])
        else:
            yield x


def has_main(symbols) -> bool:
    return any(s[0] == "<" and (s[1:].split(" ")[0] in MAIN) for s in symbols)


def slots(wrapper: list, main: bool | None = None) -> list[bool]:
    """For each text slot, in order, whether it is content; ``main``: whether the host has a main element."""
    region, out = Region(has_main(_flat(wrapper)) if main is None else main), []
    for s in _flat(wrapper):
        if s == TEXT:
            out.append(region.content())
        else:
            region.see(s)
    return out


def numbered(wrapper: list, first: int = 0) -> list:
    """The wrapper with the number of each text place instead of TEXT."""
    n = first - 1

    def number(items: list) -> list:
        nonlocal n
        out = []
        for x in items:
            if x == TEXT:
                n += 1
            out.append([x[0], number(x[1])] if isinstance(x, list) else n if x == TEXT else x)
        return out

    return number(wrapper)


def _greedy(wrapper: list, symbols: list[str]) -> list[int] | None:
    """The places of the texts if every group is taken as often as it can be, or None."""

    def run(items: list, at: int, got: list[int]) -> int:
        for x in items:
            if isinstance(x, int):
                if at < len(symbols) and symbols[at] == TEXT:
                    got.append(x)
                    at += 1
            elif isinstance(x, str):
                if at >= len(symbols) or symbols[at] != x:
                    return -1
                at += 1
            else:
                times = 0
                while True:
                    mark = len(got)
                    to = run(x[1], at, got)
                    if to < 0:
                        del got[mark:]
                        break
                    times += 1
                    if to == at or x[0] == "?":
                        at = to
                        break
                    at = to
                if x[0] == "+" and not times:
                    return -1
        return at

    got: list[int] = []
    return got if run(wrapper, 0, got) == len(symbols) else None


def program(wrapper: list) -> list[tuple]:
    """A wrapper as steps: a symbol, a text place, a choice of two next steps, or the end."""
    steps: list[tuple] = []

    def put(items: list) -> None:
        for x in items:
            at = len(steps)
            if isinstance(x, str):
                steps.append((x, 0))
            elif isinstance(x, int):
                steps.append((None, at + 1, at + 2))  # a text may be missing
                steps.append((TEXT, x))
            elif x[0] == "?":
                steps.append(())
                put(x[1])
                steps[at] = (None, at + 1, len(steps))
            else:
                put(x[1])
                steps.append((None, at, len(steps) + 1))

    put(wrapper)
    steps.append(("", 0))
    return steps


def _follow(steps: list[tuple], symbols: list[str]) -> list[int] | None:
    """The places of the texts, following all ways through the steps at once; the first choice wins."""

    def reach(starts):
        out, seen = [], set()
        for pc, got in starts:
            todo = [pc]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                if steps[at][0] is None:
                    todo += [steps[at][2], steps[at][1]]
                else:
                    out.append((at, got))
        return out

    now = reach([(0, None)])
    for s in symbols:
        now = reach([(at + 1, (steps[at][1], got) if s == TEXT else got) for at, got in now if steps[at][0] == s])
        if not now:
            return None
    for at, got in now:
        if steps[at][0] == "":
            places = []
            while got:
                places.append(got[0])
                got = got[1]
            return places[::-1]
    return None


def match(wrapper: list, symbols: list[str]) -> list[int] | None:
    """The place of each text of the page in a numbered wrapper, or None if it does not match."""
    places = _greedy(wrapper, symbols)
    return _follow(program(wrapper), symbols) if places is None else places


def ready_for(wrappers: list[list]) -> list[tuple[list, int, list[bool]]]:
    """Each wrapper of a host, its places numbered on from those before, and the content of its places."""
    main, out, first = any(has_main(_flat(w)) for w in wrappers), [], 0
    for w in wrappers:
        content = slots(w, main)
        out.append((numbered(w, first), first, content))
        first += len(content)
    return out


def placed(page: str | None, wrappers: list[tuple[list, int, list[bool]]]) -> tuple[list[str], list[int]]:
    """The texts of the page that do not stand outside its content, and their places (-1: no wrapper matches)."""
    symbols, texts = tokens(page)
    for wrapper, first, content in wrappers:
        places = match(wrapper, symbols)
        if places is not None and len(places) == len(texts):
            keep = [i for i, p in enumerate(places) if content[p - first]]
            return [texts[i] for i in keep], [places[i] for i in keep]
    own = [t for t, keep in zip(texts, slots(symbols), strict=True) if keep]
    return own, [-1] * len(own)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON, the list of the host's wrappers) of ``pages(host, html)``."""

    @tidy
    def streams(batches):
        for batch in batches:
            rows = [json.dumps([fold(tokens(p)[0])]) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(rows, pa.string())], names=["host", "stream"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pages", "stream"], ascending=[False, True])
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "stream": [json.dumps(infer_all([w for s in pdf.stream for w in json.loads(s)]))], "pages": [pdf.pages.sum()]})

    schema = "host string, stream string, pages long"
    now = Table(pages.select("host", "html").mapInArrow(streams, "host string, stream string").groupBy("host", "stream").agg(F.count("*").alias("pages")), "layouts").df
    most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while True:
        # as many groups as keep each at some FAN streams, until one is left of each host
        groups = -(-most // FAN)
        now = now.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(groups)).alias("group") if groups > 1 else F.lit(0).alias("group")).applyInPandas(joined, schema)
        if groups <= 1:
            return now.select("host", F.col("stream").alias("wrapper"))
        now, most = Table(now, "layouts").df, groups


def template_texts(texts: DataFrame) -> DataFrame:
    """``host, template``: the places and hashes of the texts that hosts repeat, of ``texts(host, texts, places)``.

    Only hashes are shuffled, one row for each distinct page and place. A host's template has at most a
    few texts for each place, since each stands on half of the pages that have the place.
    """
    keys = F.array_distinct(F.arrays_zip(F.col("places").alias("place"), F.transform("texts", lambda x: F.xxhash64(x)).alias("text")))
    pages = texts.select("host", F.xxhash64("texts").alias("page"), F.filter(keys, lambda x: x["place"] >= 0).alias("keys")).groupBy("host", "page").agg(F.first("keys").alias("keys"))
    pages = Table(pages, "pages").df
    of_host = pages.groupBy("host").agg(F.count("*").alias("all"))
    of_place = pages.select("host", F.explode(F.array_distinct(F.transform("keys", lambda x: x["place"]))).alias("place")).groupBy("host", "place").agg(F.count("*").alias("pages"))
    of_text = pages.select("host", F.explode("keys").alias("x")).groupBy("host", "x.place", "x.text").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    often = of_text.join(of_place, ["host", "place"]).where(2 * F.col("n") >= F.col("pages")).join(of_host, "host").where(5 * F.col("n") >= F.col("all"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tuned(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    known = Table(wrappers(pages), "wrappers").df

    @tidy
    def run(batches):
        ready: dict[str, list[tuple[list, int, list[bool]]]] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
                if wrapper is not None and wrapper not in ready:
                    if len(ready) > 200:
                        ready.clear()
                    ready[wrapper] = ready_for(json.loads(wrapper))
                out.append(placed(page, ready.get(wrapper, [])))
            texts, places = pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], texts, places], names=["page_id", "url", "host", "texts", "places"])

    # small tables of wrappers are broadcast by their size; otherwise hot hosts are split by AQE
    keyed = pages.join(known, "host", "left").select("page_id", "url", "host", "html", "wrapper")
    found = Table(keyed.mapInArrow(run, "page_id long, url string, host string, texts array<string>, places array<int>"), "texts").df
    own = F.transform("texts", lambda x, i: F.when(F.coalesce(F.array_contains("template", F.struct(F.get("places", i).alias("place"), F.xxhash64(x).alias("text"))), F.lit(False)), F.lit(None)).otherwise(x))
    # a table of its own: where it is small the texts are not shuffled, otherwise hot hosts are split by AQE
    template = Table(template_texts(found), "template").df
    texts = found.join(template, "host", "left").select("page_id", "url", F.array_join(own, "\n").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
