"""Main text of web pages: nearest-URL page differencing, under what a page's markup declares.

A page is read as lines, one for each block of its markup. Pages are paired with their nearest different neighbours in
the order of host and URL path; the lines of a pair are aligned by longest common subsequence, and lines they share are
deleted: what stands on both is the site's, not the page's. Copies side by side are one run, and a page is paired with
pages of other runs only, as what copies share is their text. Markup decides where differencing can't: lines inside
menus, footers, adverts, forms and the like go even where no neighbour repeats them, and lines beside a declared article
go. A line of a declared article goes only if all of three or more neighbours with other texts repeat it: one or two may
well quote it or have the same headline.

Pairing moves hashes of lines, never texts. Neighbours are found by place in a range-partitioned order, so a host or a
run of copies may hold any share of the pages.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import running_total
from spanloom.operators.skew import lookup_join
from spanloom.staging import stage

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary"}
ONE_OF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("body article main section div ul ol dl table aside nav header footer form blockquote".split())
CHROME = frozenset("nav footer aside form head menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr menu modal "
    "nav navbar navigation newsletter notice notices popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe widget".split()
)
_NAME = re.compile(r"[a-z0-9]+")
#: Runs of copies on either side that a page is paired with.
NEAREST = 2
#: Neighbours with other texts that have to repeat a line of a declared article.
AGREE = 3


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_article):
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id") and not NAMES.isdisjoint(_NAME.findall(value)):
            return tag not in ("html", "body")
    return False


class _Tags:
    """Comments and tags of a source, one after another, in time linear in it.

    Where a tag ends is decided at its quotes and closing brackets; one that leads to no end is remembered, so that no
    later tag follows it again.
    """

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self.dead: set[int] = set()
        self.from_, self.special = 0, -1  # the first special character at or behind from_
        self.last_close = source.rfind(">")

    def _end(self, at: int) -> int:
        """The place of the bracket that closes a tag whose attributes begin at `at`, or -1."""
        if not self.from_ <= at <= self.special:
            m = _SPECIAL.search(self.source, at)
            self.from_, self.special = at, m.start() if m else self.size
        place, seen = self.special, []
        while place < self.size and place not in self.dead:
            if self.source[place] == ">":
                return place
            seen.append(place)
            closing = self.source.find(self.source[place], place + 1)
            if closing < 0:
                break
            m = _SPECIAL.search(self.source, closing + 1)
            place = m.start() if m else self.size
        self.dead.update(seen)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next one; comments and the like have no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else self.size, "", "", ""
            m = _TAG.match(source, start)
            if m and (end := self._end(m.end())) >= 0:
                return start, end + 1, m[1], m[2], source[m.end() : end]
            if source[start + 1 : start + 2] in ("!", "?", "/") and start + 2 <= self.last_close:
                return start, source.find(">", start + 2) + 1, "", "", ""
            at = start + 1
        return None


def page_lines(source: str) -> list[tuple[str, bool, bool]]:
    """(text, in a declared article, in declared chrome) of each block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, opens an article, opens chrome
    opened: Counter[str] = Counter()
    article = chrome = 0

    def end_line() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, article > 0, chrome > 0))
            parts.clear()

    def pop_to(place: int) -> None:
        nonlocal article, chrome
        while len(stack) > place:
            name, a, c = stack.pop()
            opened[name] -= 1
            article -= a
            chrome -= c

    at, size, tags = 0, len(source), _Tags(source)
    while at < size:
        found = tags.after(at)
        if not found:
            parts.append(html.unescape(source[at:]))
            break
        start, end, slash, name, attributes = found
        if start > at:
            parts.append(html.unescape(source[at:start]))
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag in BLOCK:
                end_line()
            for place in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[place][0] == tag:
                    if any(s[0] in BLOCK or s[1] or s[2] for s in stack[place:]):
                        end_line()
                    pop_to(place)
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style"):
                m = re.compile(rf"</{re.escape(tag)}", re.I).search(source, at)
                at = source.find(">", m.end()) + 1 or size if m else size
            continue
        if tag in BLOCK:
            end_line()
        closing = ONE_OF.get(tag, {"p"} if tag in CLOSES_P else set()) | ({"p"} if tag in CLOSES_P else set())
        if any(opened[c] > 0 for c in closing):
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] in closing:
                    pop_to(place)
                    break
                if stack[place][0] in HOLDERS and not (tag in ("tr", "td", "th") and stack[place][0] != "table"):
                    break
        if tag in VOID:
            continue
        is_article = tag in ("article", "main")
        is_chrome = _is_chrome(tag, attributes, article > 0)
        if is_chrome:
            end_line()
        stack.append((tag, is_article, is_chrome))
        opened[tag] += 1
        article += is_article
        chrome += is_chrome
    end_line()
    return out


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence in a and in b, with the rows of a bit per line of b."""
    place: dict[int, int] = {}
    for k, x in enumerate(b):
        place[x] = place.get(x, 0) | (1 << k)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & place.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, left, right = len(a), len(b), [], []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
    return left[::-1], right[::-1]


def alike(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> bool:
    """Whether two pages are copies or nearly: more than three quarters of their lines and of their characters align."""
    if a == b:
        return True
    least, common = 3 * max(len(a), len(b)), set(b)
    if 4 * sum(x in common for x in a) <= least:
        return False
    places = common_lines(a, b)[0]
    return 4 * len(places) > least and 4 * sum(a_sizes[k] for k in places) > 3 * max(sum(a_sizes), sum(b_sizes))


def _kept(source: str) -> tuple[list[tuple[str, bool]], bool]:
    """Text of each line and whether markup leaves it to choose from; whether the page declares an article."""
    found = page_lines(source)
    declared = any(a and not c for _, a, c in found)
    return [(t, not c and (a or not declared)) for t, a, c in found], declared


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the lines its markup leaves to choose from: text and hash."""
    for batch in batches:
        lines = [[{"text": t, "hash": _line_hash(t)} for t, kept in _kept(source or "")[0] if kept] for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, _LINES)], [*batch.schema.names[:-1], "lines"])


_LINES = pa.list_(pa.struct([("text", pa.string()), ("hash", pa.int64())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the hashes of all its lines, the lengths of those to choose from (else 0), and whether it declares an article."""
    for batch in batches:
        hashes, sizes, declares = [], [], []
        for source in batch.column("html").to_pylist():
            found, declared = _kept(source or "")
            hashes.append([_line_hash(t) for t, _ in found])
            sizes.append([len(t) if kept else 0 for t, kept in found])
            declares.append(declared)
        columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(declares, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "hashes", "sizes", "declared"])


def _choice(hashes: list[int], sizes: list[int]) -> tuple[list[int], list[int]]:
    """Hashes and lengths of the lines to choose from."""
    return [h for h, s in zip(hashes, sizes, strict=True) if s], [s for s in sizes if s]


def _opens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """1 for each page that begins a run: it is no copy of the page before, or has none on its host."""
    for batch in batches:
        opens = [
            int(h2 is None or not alike(*_choice(h1, s1), *_choice(h2, s2)))
            for h1, s1, h2, s2 in zip(*(batch.column(c).to_pylist() for c in ("hashes", "sizes", "hashes2", "sizes2")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("host"), pa.array(opens, pa.int32())], ["place", "host", "opens"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each pair's common subsequence that the first page can lose, if the second is no copy of it.

    `vote` tells whether the second counts for lines of a declared article: at most half of their text is the same.
    """
    names = ("key", "declared", "hashes", "sizes", "other", "hashes2", "sizes2")
    for batch in batches:
        key, declares, other, vote, dead = [], [], [], [], []
        for k, declared, h1, s1, o, h2, s2 in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            (a, a_sizes), (b, b_sizes) = _choice(h1, s1), _choice(h2, s2)
            if alike(a, a_sizes, b, b_sizes):
                continue
            places = [] if set(a).isdisjoint(h2) else [p for p in common_lines(h1, h2)[0] if s1[p]]
            key.append(k)
            declares.append(declared)
            other.append(o)
            vote.append(bool(b) and 2 * sum(s1[p] for p in places) <= max(sum(a_sizes), sum(b_sizes)))
            dead.append(sorted({h1[p] for p in places}))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(declares, pa.bool_()), pa.array(other, pa.int64()), pa.array(vote, pa.bool_()), pa.array(dead, pa.list_(pa.int64()))],
            ["key", "declared", "other", "vote", "dead"],
        )


def _neighbours(placed: DataFrame) -> DataFrame:
    """(place, other): each page with the nearest page of each of the NEAREST runs before and after its own on its host."""
    before = placed.select((F.col("place") + 1).alias("place"), "host", F.col("hashes").alias("hashes2"), F.col("sizes").alias("sizes2"))
    opens = placed.select("place", "host", "hashes", "sizes").join(before, ["place", "host"], "left")
    opens = opens.mapInArrow(_opens, "place long, host string, opens int")
    runs = stage(running_total(opens, ["place"], "opens", "run").select("place", "host", (F.col("run") + F.col("opens")).alias("run")))
    ends = runs.groupBy("host", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    steps = F.explode(F.array(*[F.lit(k) for d in range(1, NEAREST + 1) for k in (-d, d)]))
    others = (
        ends.withColumn("step", steps)
        .select("host", (F.col("run") - F.col("step")).alias("run"), F.when(F.col("step") > 0, F.col("first")).otherwise(F.col("last")).alias("other"))
        .groupBy("host", "run").agg(F.collect_list("other").alias("others"))
    )
    return lookup_join(runs, others, ["host", "run"]).select("place", F.explode("others").alias("other"))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_chars, n_shared) per row of pages: page_id, url, html.

    text joins the lines that stay by a space, with character references decoded and white space inside a line as one
    space; it is empty if none stay or html is null. n_chars counts its code points, n_shared the lines deleted because
    neighbours by URL have them. Pages whose url is null or has no host are each other's neighbours as one host; copies
    and near copies delete nothing from each other. Repeated rows are rows of their own. Runs jobs.
    """
    key = F.xxhash64("page_id", "url", "html")
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    base = pages.select("page_id", "url", "html")
    light = base.select(key.alias("key"), host.alias("host"), path.alias("path"), F.lit(1).alias("one"), "html")
    hashed = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("one", T.IntegerType()),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("declared", T.BooleanType()),
    ])
    # Staged first, as dealing rows out by ranges reads them twice.
    placed = stage(running_total(stage(light.mapInArrow(_hashed, hashed)), ["host", "path", "key"], "one", "place").drop("one", "path"))
    other = placed.select(F.col("place").alias("other"), F.col("hashes").alias("hashes2"), F.col("sizes").alias("sizes2"))
    pairs = lookup_join(_neighbours(placed), other, ["other"]).join(placed.filter("exists(sizes, x -> x > 0)"), "place")
    found = pairs.select("key", "declared", "hashes", "sizes", "other", "hashes2", "sizes2").mapInArrow(
        _aligned, "key long, declared boolean, other long, vote boolean, dead array<long>"
    )
    # Repeated rows have one key and the same neighbours.
    repeats = F.collect_set(F.when(F.col("vote"), F.struct("other", "dead")))
    by_all = F.aggregate(F.transform("repeats", lambda x: x["dead"]), F.element_at("repeats", 1)["dead"], lambda a, x: F.array_intersect(a, x))
    dead = (
        found.groupBy("key").agg(F.first("declared").alias("declared"), repeats.alias("repeats"), F.array_distinct(F.flatten(F.collect_set("dead"))).alias("any"))
        .select("key", F.when(~F.col("declared"), F.col("any")).when(F.size("repeats") >= AGREE, by_all).alias("dead"))
        .filter(F.size("dead") > 0)
    )
    parsed = T.StructType([
        T.StructField("page_id", base.schema["page_id"].dataType), T.StructField("url", base.schema["url"].dataType), T.StructField("key", T.LongType()),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("hash", T.LongType())]))),
    ])
    lines = base.select("page_id", "url", key.alias("key"), "html").mapInArrow(_parsed, parsed)
    gone = F.coalesce("dead", F.array().cast("array<bigint>"))
    stays = F.filter("lines", lambda x: ~F.array_contains(gone, x["hash"]))
    return lines.join(stage(dead), "key", "left").select(
        "page_id", "url", F.array_join(F.transform(stays, lambda x: x["text"]), " ").alias("text"), (F.size("lines") - F.size(stays)).alias("n_shared")
    ).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_shared").cast("long").alias("n_shared"))
