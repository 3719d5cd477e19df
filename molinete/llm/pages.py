"""Main text of web pages: each page against its nearest by URL, shared lines by longest common subsequence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molinete.llm.common import durable, text_of
from molinete.llm.markup import ARTICLE, ASIDE_BLOCK, OPEN, blocks

#: Tables of the alignment are kept whole up to so many cells; larger ones are halved first.
_CELLS = 1 << 22
#: A page that holds more of another's open text than this may be a copy of it, which says nothing of the template.
COPY_SHARE = 0.9
#: How many pages, no two of them copies, are tried on either side of a page.
TRIED = 4


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def common_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of ``a`` that a longest common subsequence with ``b`` keeps; exact, in memory linear in the longer beyond a fixed table."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.zeros(0, np.int64)
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    front = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[front:][::-1][: k - front] != b[front:][::-1][: k - front])
    back = int(differ[0]) if len(differ) else k - front
    if front or back:
        middle = common_places(a[front : n - back], b[front : m - back])
        return np.concatenate([np.arange(front), middle + front, np.arange(n - back, n)])
    if n == 1:
        return np.flatnonzero(np.isin(a, b))
    if n * m > _CELLS:
        half = n // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = int(np.argmax(left + right[::-1]))
        return np.concatenate([common_places(a[:half], b[:cut]), common_places(a[half:], b[cut:]) + half])
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        row = table[i + 1]
        row[1:] = np.maximum(table[i, 1:], np.where(b == a[i], table[i, :-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(i)
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return np.array(out[::-1], np.int64)


def _line(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shared_start(a: str, b: str) -> int:
    k = min(len(a), len(b))
    return next((i for i in range(k) if a[i] != b[i]), k)


_PAGE = "host string, path string, lines array<bigint>, places array<tinyint>, sizes array<int>"
_ORDER = ["host", "path", "page_id", "key"]
_NEAR = pa.struct(
    [("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("places", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int32()))]
)


def _lines(pages: DataFrame) -> DataFrame:
    """``(key, page_id, host, path, sign, lines, places, sizes)`` of each page: its text lines as 64-bit hashes, what their place says, their lengths;
    ``sign`` is a hash of lines and places."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, lines, places, sizes = [], [], [], []
            for html in batch.column("html"):
                found = blocks(html.as_py())
                lines.append([_line(t) for _, t in found])
                places.append([p for p, _ in found])
                sizes.append([len(t) for _, t in found])
                signs.append(blake2b(np.array(lines[-1], "<i8").tobytes() + bytes(places[-1]), digest_size=16).digest())
            columns = [*(batch.column(c) for c in ("key", "page_id", "host", "path")), pa.array(signs, pa.binary())]
            columns += [pa.array(lines, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int8())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "page_id", "host", "path", "sign", "lines", "places", "sizes"])

    rows = pages.select(
        "key",
        "page_id",
        F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_replace("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "").alias("path"),
        "html",
    )
    return rows.mapInArrow(parse, f"key binary, page_id bigint, host string, path string, sign binary, {_PAGE.split(', ', 2)[2]}")


@dataclass
class Page:
    """A page as its neighbours see it; ``total`` is the size of its text without furniture, ``open`` of the part whose place says nothing."""

    host: str
    path: str
    lines: np.ndarray
    places: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.lines, self.places, self.sizes = np.asarray(self.lines, np.int64), np.asarray(self.places, np.int8), np.asarray(self.sizes, np.int64)
        inside = self.places != ASIDE_BLOCK
        self.body, self.body_sizes = self.lines[inside], self.sizes[inside]
        self.total, self.open = int(self.body_sizes.sum()), int(self.sizes[self.places == OPEN].sum())

    def packed(self) -> dict:
        return {"host": self.host, "path": self.path, "lines": self.lines.tolist(), "places": self.places.tolist(), "sizes": self.sizes.tolist()}

    def copies(self, other: Page, share: float) -> bool:
        """Whether either is little else than the other."""
        least = share * max(self.total, other.total)
        if self.body_sizes[np.isin(self.body, other.body)].sum() <= least:
            return self.total == other.total == 0
        return int(self.body_sizes[common_places(self.body, other.body)].sum()) > least

    def template(self, near: Iterable[Page], share: float) -> list[int]:
        """The places of the open lines that stand in the nearest page, of those ``near`` (nearest first), that is not a copy of this one.

        A page that has over ``share`` of this one's open text is no copy if that is at most half of its own, and not all of this one's. Where
        every page has so much, yet some have much besides, what all of those share (two or more) goes, if something stays.
        """
        held: list[np.ndarray] = []
        for other in near:
            same = common_places(self.lines, other.lines)
            gone = same[self.places[same] == OPEN]
            size = int(self.sizes[gone].sum())
            if size <= share * self.open or size < self.open and size <= other.total / 2:
                return gone.tolist()
            if size <= share * max(self.open, other.total):
                held.append(gone)
        if len(held) < 2:
            return []
        common = sorted(set(held[0].tolist()).intersection(*(g.tolist() for g in held[1:])))
        return common if int(self.sizes[common].sum()) < self.open else []


def _seen(pages: list[Page], page: Page, share: float) -> list[Page]:
    """``pages`` (nearest first, no two copies) with ``page`` in front."""
    return [page, *(p for p in pages if p.host == page.host and not page.copies(p, share))][:TRIED]


def _sorted_pages(table: pa.Table) -> tuple[pa.Table, list[Page]]:
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in _ORDER], null_placement="at_start"))
    columns = [table.column(c).to_pylist() for c in ("host", "path")] + [[x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("lines", "places", "sizes")]
    return table, [Page(*row) for row in zip(*columns, strict=True)]


def _edges(dealt: DataFrame, share: float) -> DataFrame:
    """``(part, before, after)``: the pages last seen before each range and after it, nearest first, no two of them copies, of one host each.

    Each range hands over at most ``2 * TRIED`` pages; one task goes over these in the order of the ranges and back.
    """
    near = "array<struct<host:string,path:string,lines:array<bigint>,places:array<tinyint>,sizes:array<int>>>"

    def ends(table: pa.Table) -> pa.Table:
        part, (_, pages) = table.column("part")[:1], _sorted_pages(table)
        found = []
        for way in (pages, pages[::-1]):
            seen: list[Page] = []
            for page in way:
                seen = _seen(seen, page, share)
            found.append(pa.array([[p.packed() for p in seen]], pa.list_(_NEAR)))
        whole = pa.array([pages[0].host == pages[-1].host], pa.bool_())
        return pa.table([part, found[1], found[0], whole], ["part", "first", "last", "whole"])

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        met: dict[str, list] = {"last": [], "first": []}
        for side, way in (("last", rows), ("first", rows[::-1])):
            seen: list[Page] = []
            for row in way:
                met[side].append([p.packed() for p in seen])
                own = [Page(**p) for p in row[side]]
                seen = seen if row["whole"] else []
                for page in own[::-1]:
                    seen = _seen(seen, page, share)
        columns = [pa.array([r["part"] for r in rows], pa.int32()), pa.array(met["last"], pa.list_(_NEAR)), pa.array(met["first"][::-1], pa.list_(_NEAR))]
        return pa.table(columns, ["part", "before", "after"])

    found = dealt.select("part", *_ORDER, "lines", "places", "sizes").groupBy("part").applyInArrow(ends, f"part int, first {near}, last {near}, whole boolean")
    return durable(found.groupBy().applyInArrow(fold, f"part int, before {near}, after {near}"))


def shared_lines(lines: DataFrame, *, copy_share: float = COPY_SHARE) -> DataFrame:
    """``(key, dropped)``: for pages where it matters, the places of the open lines that the page shares with its nearest one.

    Pages of a host with the same lines are one page, the first of them, and lose the same. The pages of a host are in the order (path,
    page_id, key); the nearest of those before and after is the one whose path agrees longest with the page's own from the front, the earlier of
    two equal ones. Where it is a copy (``Page.template``) the next is tried, up to ``TRIED`` on either side, no two of which are copies of one
    another (over ``copy_share`` of both). On a host of nothing but copies nothing goes. All lines of both pages are aligned. Deleted
    are shared lines whose place says nothing; lines of an article body stay, lines of page furniture go anyway.

    The order is cut into ranges, whatever the host, so a host with a third of all pages is dealt to a third of the tasks.
    """
    lines = durable(lines)
    first = Window.partitionBy("host", "sign").orderBy("path", "page_id", "key")
    single = lines.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(single.repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id()))

    def differ(table: pa.Table, edges: pa.Table) -> pa.Table:
        table, pages = _sorted_pages(table)
        (met,) = edges.to_pylist()
        before, after = ([Page(**p) for p in met[side]] for side in ("before", "after"))
        behind: list[list[Page]] = []
        for page in pages[::-1]:
            behind.append(after)
            after = _seen(after, page, copy_share)
        signs, hosts, dropped = [], [], []
        for page, sign, rest in zip(pages, table.column("sign").to_pylist(), behind[::-1], strict=True):
            if page.open and ARTICLE not in page.places:
                near = [p for p in (*before, *rest) if p.host == page.host]
                near.sort(key=lambda p: -_shared_start(p.path, page.path))
                if gone := page.template(near, copy_share):
                    signs.append(sign)
                    hosts.append(page.host)
                    dropped.append(gone)
            before = _seen(before, page, copy_share)
        return pa.table([pa.array(hosts, pa.string()), pa.array(signs, pa.binary()), pa.array(dropped, pa.list_(pa.int32()))], ["host", "sign", "dropped"])

    edges = _edges(dealt, copy_share)
    found = dealt.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(differ, "host string, sign binary, dropped array<int>")
    return lines.select("key", "host", "sign").join(durable(found), ["host", "sign"]).select("key", "dropped").dropDuplicates(["key"])


def main_text(pages: DataFrame, *, copy_share: float = COPY_SHARE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Blocks in an article or main element are the text of a page that has one. On a page without, what its
    place names as furniture goes, and so does each line that the page shares with its nearest by URL on the same host that is not a copy of it. Only line
    hashes are dealt out to find and align neighbours; the decisions, where there are any, are joined back to the pages.

    A null html is empty and gives an empty text. A null url is a host of its own kind, without a path. Rows that repeat a page
    are its copies and lose nothing to one another. An empty table gives no rows.
    """
    keyed = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("page_url"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        text_of(html).alias("html"),
    ).withColumn("key", F.unhex(F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), "url", "html").cast("binary"))))
    decisions = durable(shared_lines(_lines(keyed), copy_share=copy_share))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, gone in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                found = blocks(body.as_py())
                article = any(p == ARTICLE for p, _ in found)
                gone = set(gone or ())
                texts.append(" ".join(t for i, (p, t) in enumerate(found) if (p == ARTICLE if article else p != ASIDE_BLOCK and i not in gone)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    joined = keyed.join(decisions, "key", "left").select("page_id", "page_url", "html", "dropped")
    return joined.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
