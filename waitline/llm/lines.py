"""Line dedup by site-relative frequency.

A host's boilerplate line is one found on more than `ratio` of its pages (and on `least` pages at
least). Lines of a page are its text between tags, trimmed; a page loses its boilerplate lines.

Pages are cut into lines in one pass each: a comment, script or style is sought its end once, and a mark
that is never closed hides nothing and is not sought again, so time grows with a page's length whatever
it holds. Counting and dropping are joins.

Defined cases: a null or empty html has no lines and gives an empty text; a url without a host, or a
null one, belongs to the host ""; a line repeated on a page counts once for the page and is dropped or
kept wherever it stands; pages that repeat an id are pages of their own, told apart by their content
(fully equal rows count and stay as often as they occur); a very long page is read whole, in memory of a few
times its size; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.sources.session import ship_package
from waitline.sources.tables import lookup

RATIO, LEAST = 0.1, 2  # a line on one page is never repeated

OPENING = re.compile(r"<!--|<(script|style)\b", re.I | re.A)
CLOSING = {None: re.compile("-->"), **{k: re.compile(rf"</{k}\s*>", re.I | re.A) for k in ("script", "style")}}
BETWEEN = re.compile(r"<[^>]*>|\n")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def lines_of(html: str) -> list[str]:
    """Visible lines: comments, scripts and styles go, tags part lines, blanks at the ends go."""
    shown, start, at, unclosed = [], 0, 0, set()
    while len(unclosed) < len(CLOSING) and (opening := OPENING.search(html, at)):
        at = opening.end()
        kind = opening[1] and opening[1].lower()
        if kind in unclosed:
            continue
        closing = CLOSING[kind].search(html, at)
        if closing is None:
            unclosed.add(kind)
            continue
        shown.append(html[start:opening.start()])
        start = at = closing.end()
    bare = "\n".join([*shown, html[start:]])
    last = bare.rfind(">") + 1  # no tag ends behind it
    parts = BETWEEN.split(bare[:last]) if last else [""]
    rest = bare[last:].split("\n")
    return [x for p in [*parts[:-1], parts[-1] + rest[0], *rest[1:]] if (x := p.strip(" "))]


def with_lines(pages: DataFrame) -> DataFrame:
    """page_id, host and lines of every page."""
    ship_package(pages.sparkSession)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), "html")

    def run(batches):
        for b in batches:
            lines = pa.array([lines_of(h.as_py() or "") for h in b["html"]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], lines], names=["page_id", "host", "lines"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, lines array<string>")


def line_counts(pages: DataFrame) -> DataFrame:
    """host, line_hash, pages that hold the line. Lines are counted once per page, combined before the shuffle."""
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    return lines.groupBy("host", F.xxhash64("line").alias("line_hash")).agg(F.count(F.lit(1)).alias("n_pages"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (lines that stay, joined by line ends)."""
    rows = with_lines(pages)
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    common = (line_counts(rows).where(F.col("n_pages") >= least).join(totals, "host")
              .where(F.col("n_pages") > ratio * F.col("total")).select("host", "line_hash"))
    # A host has at most (lines of a page) / ratio such lines, so one row per host holds them.
    drops = lookup(common.groupBy("host").agg(F.collect_set("line_hash").alias("drop")))
    out = rows.join(drops, "host", "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("drop", F.xxhash64(x)), F.lit(False)))
    out = out.withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("text"))
