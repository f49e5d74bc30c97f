"""Main text of web pages by nearest-URL page differencing.

Each distinct host and path is represented by its page of least id.  Representatives
are sorted by host and URL path across the cluster, and the ends of each range are known
to all, so every path finds the nearest different path of its host.  The text lines of
a page and of that path's representative are aligned by their longest common
subsequence; lines that they share are the site's frame and are deleted, inside a main
element too.  Lines inside an article element stay: two pages may carry one article or
quote one passage.  Of what is left, the lines of an article or main element are taken
if there are any; a page whose main element is shared as a whole keeps its lines.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are known by their elements and names.

Partners travel as hashes of their lines.  A path with a third of all pages is one row
in the order of paths, and its pages are dealt over SALTS keys to meet their partner.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SALTS = 64
OUT = "page_id long, url string, text string, n_chars long"
#: Elements whose content is never main text (fixed values).
DROPPED = set("head title script style noscript template nav footer aside form button select textarea input label fieldset iframe object embed svg canvas dialog menu audio video".split())
#: Elements without content (fixed values).
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a block (fixed values).
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|menu|modal|nav|navbar|newsletter|notice|popup|promo|related|replies|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe)(?:$|[\s_-])", re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def lines_of(page: str) -> tuple[list[tuple[str, int]], bool]:
    """``(line, 1 inside main, 2 inside an article, else 0)`` in page order without dropped elements; whether there is an article.

    Unclosed elements end with what encloses them; a page cut short ends them all.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, dropped, inside main (1) or an article (2)
    parts: list[str] = []
    found, at = False, 0

    def flush() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                out.append((line, stack[-1][2] if stack else 0))
            parts.clear()

    for token in _TOKEN.finditer(page):
        if token.start() > at and not (stack and stack[-1][1]):
            parts.append(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if token[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    break
            continue
        dropped, inside = stack[-1][1:] if stack else (False, 0)
        if tag == "p" or tag == "li":  # a new one ends the one before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    dropped, inside = stack[-1][1:] if stack else (False, 0)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if not dropped:
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(token[4] or ""))
            dropped = tag in DROPPED or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and bool(names) and bool(_NAMED.search(names)))
            if dropped and not (stack and stack[-1][1]):
                flush()
        if tag in ("article", "main") and not dropped:
            inside, found = max(inside, 2 if tag == "article" else 1), True
        stack.append((tag, dropped, inside))
    if at < len(page) and not (stack and stack[-1][1]):
        parts.append(page[at:])
    flush()
    return out, found


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` on a longest common subsequence with ``b``; bits of one integer are a row of the table."""
    masks: dict = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    row, table = (1 << len(a)) - 1, []
    full = row
    for line in b:
        use = row & masks.get(line, 0)
        row = ((row + use) | (row - use)) & full
        table.append(row)
    out, i, j = set(), len(b), len(a)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                out.add(j)
    return out


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(line) - 2**63 for line, _ in lines]


def main_text(lines: list[tuple[str, int]], article: bool, partner: list[int] | None) -> str:
    """The lines that the partner page (its line hashes) doesn't share, and those of an article; of them the article's or main's, if it has any."""
    gone = shared_lines(line_hashes(lines), partner) if partner else set()
    if len(gone) == len(lines):  # the same page again says nothing about the frame
        gone = set()
    left = [x for i, x in enumerate(lines) if i not in gone or x[1] == 2]
    if article:
        inside = [x for x in left if x[1]] or [x for x in lines if x[1]]
        left = inside or left
    return "\n\n".join(line for line, _ in left)


def _nearness(a: str, b: str) -> int:
    """Length of the paths' common beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _hashed(batches):
    for batch in batches:
        html = batch.column("html").to_pylist()
        lines = pa.array([line_hashes(lines_of(x or "")[0]) for x in html], pa.list_(pa.int64()))
        yield pa.record_batch([*(batch.column(c) for c in ("host", "path", "salt", "page_id")), lines], names=["host", "path", "salt", "page_id", "lines"])


def _ends(batches):
    """First and last row of a range."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1).to_pylist()[0]
            last = batch.slice(batch.num_rows - 1, 1).to_pylist()[0]
    if first:
        yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("host", "path", "lines")} for x in (first, last)], pa.schema([("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))]))


def partners(distinct: DataFrame) -> DataFrame:
    """``host, path, salts, partner``: for each distinct path the lines of the nearest different path of its host."""
    ordered = cut(distinct.repartitionByRange("host", "path").sortWithinPartitions("host", "path"))
    ends = sorted({(r.host, r.path): r.lines for r in ordered.select("host", "path", "lines").mapInArrow(_ends, "host string, path string, lines array<long>").collect()}.items(), key=lambda x: (x[0][0].encode(), x[0][1].encode()))  # two rows a range
    place = {key: i for i, (key, _) in enumerate(ends)}
    shared = distinct.sparkSession.sparkContext.broadcast((ends, place))

    def choose(batches):
        ends, place = shared.value

        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def outside(key, step):
            i = place[key] + step
            return {"host": ends[i][0][0], "path": ends[i][0][1], "lines": ends[i][1]} if 0 <= i < len(ends) else None

        def result(before, now, after):
            near = [p for p in (before, after) if p and p["host"] == now["host"]]
            partner = max(near, key=lambda p: _nearness(now["path"], p["path"])) if near else None
            return {"host": now["host"], "path": now["path"], "salts": now["salts"], "partner": partner and partner["lines"]}

        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("salts", pa.list_(pa.int32())), ("partner", pa.list_(pa.int64()))])
        before = now = None
        out = []
        for after in rows():
            if now:
                out.append(result(before, now, after))
                before = now
            else:
                before = outside((after["host"], after["path"]), -1)
            now = after
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            out.append(result(before, now, outside((now["host"], now["path"]), 1)))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(choose, "host string, path string, salts array<int>, partner array<long>")


def _difference(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            html, partner = part.column("html").to_pylist(), part.column("partner").to_pylist()
            texts = [main_text(*lines_of(h or ""), p) for h, p in zip(html, partner, strict=True)]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Blocks are joined by two line feeds; white space inside a block is one space.

    Defined cases: null or empty html gives an empty text; null, relative or broken
    URLs share the empty host; a page alone on its host keeps all lines that its
    elements allow; a page that equals its partner keeps its lines; repeated rows are
    extracted each; an empty table gives an empty result; other columns are ignored.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    own = F.col(id_col).cast("long")
    salt = F.pmod(F.xxhash64(own, url), F.lit(SALTS)).cast("int")
    rows = pages.select(own.alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"), path.alias("path"), salt.alias("salt"))
    hashed = rows.select("host", "path", "salt", "page_id", "html").mapInArrow(_hashed, "host string, path string, salt int, page_id long, lines array<long>")
    distinct = hashed.groupBy("host", "path").agg(F.min(F.struct("page_id", "lines")).alias("least"), F.collect_set("salt").alias("salts")).select("host", "path", "salts", "least.lines")
    found = partners(distinct).select("host", "path", F.explode("salts").alias("salt"), "partner")
    return rows.join(found, ["host", "path", "salt"], "left").select("page_id", "url", "html", "partner").mapInArrow(_difference, OUT)


def op7_extract_pages(spark, sf_dir: str) -> DataFrame:
    """Contract query 7 over all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
