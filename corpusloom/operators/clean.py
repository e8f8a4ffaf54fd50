"""Cleaning of paged text: page markers, ranges, running headers, reference lists, tables and HTML.

Everything works inside the row of its document on arrays of lines, so no step shuffles and a hot source does no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from corpusloom.functions.text import SPACE, collapse_blank_lines, let, split_lines, strip
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PagePatterns:
    """Patterns of page markers, running headers and footers."""

    marker: str = rf"^=====[{SPACE}]*第[{SPACE}]*(\d+)[{SPACE}]*页[{SPACE}]*=====[{SPACE}]*\z"
    number_only: str = r"^\d{1,3}\z"
    header_prefix: str = rf"^\d{{0,3}}[{SPACE}]*第?[{SPACE}]*[一二三四五六七八九十百]+[{SPACE}]*章"
    header_anywhere: str = r"第[一二三四五六七八九十百]+章"
    standalone: tuple[str, ...] = (
        rf"^\d{{0,3}}[{SPACE}]*第[一二三四五六七八九十百]+章[^。,，、:：;；?？!！()（）]{{0,18}}\d{{0,3}}\z",
        r"^\d{0,3}[\x{4e00}-\x{9fff}、]{0,24}实验诊断与应用\d{0,3}\z",
    )
    #: A standalone line has one of these; lines without any are not matched. Empty: all lines are.
    standalone_parts: tuple[str, ...] = ("章", "实验诊断与应用")
    header_chars: int = 30
    reference_heading: str = rf"^#{{1,6}}[{SPACE}]*参考文献[{SPACE}]*\z"
    heading: str = rf"^#{{1,6}}[{SPACE}]"


PATTERNS = PagePatterns()


def split_pages(text: Column, patterns: PagePatterns = PATTERNS) -> Column:
    """Array of (page_no, lines), in the order of the markers; text before the first marker is left out."""

    def pages(lines: Column) -> Column:
        numbered = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(patterns.marker), i)), lambda i: i.isNotNull())

        def page(marks: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(marks, k + 1), F.size(lines))
                return F.struct(F.regexp_extract(F.get(lines, at), patterns.marker, 1).cast("int").alias("page_no"), F.slice(lines, at + 2, end - at - 1).alias("lines"))

            return F.transform(marks, one)

        return let(numbered, page)

    return let(split_lines(text), pages)


def is_header(line: Column, patterns: PagePatterns = PATTERNS) -> Column:
    """A short line that is a page number or names a chapter."""
    either = "|".join(f"(?:{p})" for p in (patterns.number_only, patterns.header_prefix, patterns.header_anywhere))
    return let(strip(line), lambda s: (s != "") & (F.length(s) <= patterns.header_chars) & s.rlike(either))


def strip_page_edges(lines: Column, patterns: PagePatterns = PATTERNS, page_no: Column | None = None) -> Column:
    """The first line that is not blank goes if it is a header, then the last one if it is a page number.

    Where the page's own number is known, that is a page number of however many digits.
    """

    def without(xs: Column, at: Column) -> Column:
        return F.concat(F.slice(xs, F.lit(1), at), F.slice(xs, at + 2, F.size(xs)))

    def full(xs: Column) -> Column:
        return F.transform(xs, lambda x: x.rlike(rf"[^{SPACE}]"))

    def top(xs: Column) -> Column:
        first = F.array_position(full(xs), F.lit(True)).cast("int") - 1
        return let(first, lambda k: F.when((k >= 0) & F.coalesce(is_header(F.get(xs, k), patterns), F.lit(False)), without(xs, k)).otherwise(xs))

    def is_number(line: Column) -> Column:
        short = line.rlike(patterns.number_only)
        return short if page_no is None else short | (line == page_no.cast("string"))

    def bottom(xs: Column) -> Column:
        last = F.size(xs) - F.array_position(F.reverse(full(xs)), F.lit(True)).cast("int")
        return let(last, lambda k: F.when((k < F.size(xs)) & is_number(strip(F.get(xs, k))), without(xs, k)).otherwise(xs))

    return let(let(lines, top), bottom)


def drop_running_headers(lines: Column, patterns: PagePatterns = PATTERNS) -> Column:
    """Lines that as a whole are a running header go wherever they stand."""

    either = "|".join(f"(?:{p})" for p in patterns.standalone)

    def header(line: Column) -> Column:
        may = [line.contains(part) for part in patterns.standalone_parts]
        matched = strip(line).rlike(either)
        return reduce(or_, may) & matched if may else matched

    return F.filter(lines, lambda line: ~header(line))


def join_bodies(bodies: Column) -> Column:
    """Page bodies that are not empty, with a blank line between them and a line feed at the end."""
    return F.concat(F.array_join(F.filter(bodies, lambda b: b != ""), "\n\n"), F.lit("\n"))


def strip_references(text: Column, patterns: PagePatterns = PATTERNS) -> Column:
    """Struct (text, removed): each reference list goes from its heading to before the next other heading.

    Three passes of expressions over the whole text; the patterns of lines are taken as they are, with every class of
    white space kept within its line.
    """
    inner = SPACE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
    listed, heading = (p.replace(SPACE, inner).removeprefix("^").removesuffix(r"\z") for p in (patterns.reference_heading, patterns.heading))
    rest = rf"(?:{listed})$(?:\n(?!(?!(?:{listed})$)(?:{heading}))[^\n]*)*+"

    def run(t: Column) -> Column:
        open_ended = F.regexp_replace(t, rf"(?md)(?:\A|\n){rest}\z", "")
        return F.struct(F.regexp_replace(open_ended, rf"(?md)^{rest}\n", "").alias("text"), F.regexp_count(t, F.lit(rf"(?md)^(?:{listed})$")).alias("removed"))

    return let(text, run)


def clean_pages(documents: DataFrame, rules: DataFrame | None = None, patterns: PagePatterns = PATTERNS) -> DataFrame:
    """``documents`` (source, text) with ``pages``: an array of (page_no, in_range, changed, body).

    ``rules`` (source, body_start, index_start) tells which pages count; it holds one row a book and is joined as it
    comes. Sources without a rule keep every page.
    """
    ranged = documents.join(rules, "source", "left") if rules is not None else documents.withColumns({"body_start": F.lit(None).cast("int"), "index_start": F.lit(None).cast("int")})

    def page(p: Column) -> Column:
        inside = F.coalesce(p["page_no"] >= F.col("body_start"), F.lit(True)) & F.coalesce(p["page_no"] < F.col("index_start"), F.lit(True))
        return let(
            strip_page_edges(p["lines"], patterns, p["page_no"]),
            lambda edged: F.struct(
                p["page_no"].alias("page_no"),
                inside.alias("in_range"),
                (F.size(edged) != F.size(p["lines"])).alias("changed"),
                strip(F.array_join(drop_running_headers(edged, patterns), "\n")).alias("body"),
            ),
        )

    return ranged.withColumn("pages", F.transform(split_pages(F.col("text"), patterns), page))


def clean_text(cleaned: DataFrame) -> DataFrame:
    """``clean_pages`` with ``cleaned``: bodies in range joined, references removed, blank lines collapsed; and ref_blocks."""
    bodies = F.transform(F.filter("pages", lambda p: p["in_range"]), lambda p: p["body"])
    out = cleaned.withColumn("__s", strip_references(join_bodies(bodies)))
    return out.withColumn("cleaned", F.concat(collapse_blank_lines(F.col("__s.text")), F.lit("\n"))).withColumn("ref_blocks", F.col("__s.removed")).drop("__s")


def cleaning_stats(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """Pages in all, dropped before the body and from the index on, changed at their edges; reference lists; characters."""
    count = lambda test: F.sum(F.size(F.filter("pages", test))).cast("long")
    return clean_text(cleaned).groupBy(*keys).agg(
        F.sum(F.size("pages")).cast("long").alias("pages"),
        count(lambda p: F.coalesce(p["page_no"] < F.col("body_start"), F.lit(False))).alias("dropped_front"),
        count(lambda p: F.coalesce(p["page_no"] >= F.col("index_start"), F.lit(False)) & F.coalesce(p["page_no"] >= F.col("body_start"), F.lit(True))).alias("dropped_index"),
        count(lambda p: p["in_range"] & p["changed"]).alias("pages_changed"),
        F.sum("ref_blocks").cast("long").alias("ref_blocks"),
        F.sum(F.length("cleaned")).cast("long").alias("chars"),
    )


# ------------------------------------------------------------------------------------------------------ tables, HTML


def table_to_markdown(rows: Column) -> Column:
    """Array of arrays of cells to a Markdown table: cells stripped, empty rows dropped, short rows padded; '' if empty."""
    full = F.filter(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))), lambda r: F.exists(r, lambda c: c != ""))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def made(rs: Column) -> Column:
        def joined(width: Column) -> Column:
            padded = F.transform(rs, lambda r: line(F.when(F.size(r) == width, r).otherwise(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))))
            rule = F.array(line(F.array_repeat(F.lit("---"), width)))
            return let(padded, lambda p: F.array_join(F.concat(F.slice(p, F.lit(1), F.lit(1)), rule, F.slice(p, F.lit(2), F.size(p))), "\n"))

        return F.when(F.size(rs) == 0, "").otherwise(let(F.array_max(F.transform(rs, lambda r: F.size(r))), joined))

    return let(full, made)


# HTML patterns.
TABLE, ROW, CELL, ANY_TAG = r"(?is)<table[^>]*>.*?</table>", r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r"<[^>]+>"
LAYOUT_TAG = r"(?i)</?(div|html|body|span|p|img|br|table|tr|td|th)[^>]*>"


def html_table_to_markdown(table: Column) -> Column:
    rows = F.transform(F.regexp_extract_all(table, F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), lambda c: strip(F.regexp_replace(c, ANY_TAG, " "))))
    return let(table_to_markdown(F.filter(rows, lambda r: F.size(r) > 0)), lambda md: F.when(md == "", "").otherwise(F.concat(F.lit("\n[表格]\n"), md)))


def html_to_text(html: Column) -> Column:
    """Tables become Markdown, layout tags go, other angle brackets stay; blank lines are collapsed."""
    between = F.split(html, TABLE)
    tables = F.transform(F.regexp_extract_all(html, F.lit(TABLE), F.lit(0)), html_table_to_markdown)
    woven = F.array_join(F.zip_with(between, tables, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
    return collapse_blank_lines(F.regexp_replace(woven, LAYOUT_TAG, ""))


def detect_columns(words: DataFrame, keys: list[str], least_words: int = 40, margin: float = 0.04, crossing: float = 0.06, side: float = 0.25) -> DataFrame:
    """(keys, n_columns): 2 where few word boxes (x0, x1, page_width) cross the middle and both halves hold enough."""
    center, slack = F.col("page_width") / 2, F.col("page_width") * margin
    counted = words.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if((F.col("x0") < center - slack) & (F.col("x1") > center + slack)).alias("over"),
        F.count_if((F.col("x0") + F.col("x1")) / 2 < center).alias("left"),
    )
    n = F.col("n")
    two = (n >= least_words) & (F.col("over") / n < crossing) & (F.col("left") > n * side) & (n - F.col("left") > n * side)
    return counted.select(*keys, F.when(two, 2).otherwise(1).alias("n_columns"))


def page_text(words: DataFrame, keys: list[str], tolerance: float = 3.0, **columns) -> DataFrame:
    """(keys, n_columns, text) of word boxes (x0, x1, top, page_width, text): the left column's lines, then the right one's.

    A word starts a new line where its top is more than ``tolerance`` below that of the word before it; a line's words go from
    left to right. A word belongs to the half that its middle is in. ``columns`` are those of ``detect_columns``.
    """
    found = detect_columns(words, keys, **columns)
    right = (F.col("n_columns") == 2) & ((F.col("x0") + F.col("x1")) / 2 >= F.col("page_width") / 2)
    placed = words.join(found, keys).withColumn("__column", right.cast("int"))
    order = W.partitionBy(*keys, "__column").orderBy("top", "x0", "text")
    starts = placed.withColumn("__new", (F.coalesce(F.col("top") - F.lag("top").over(order), F.lit(0)) > tolerance).cast("int"))
    lined = starts.withColumn("__line", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = lambda x, by: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda w: w["text"]), by)
    lines = lined.groupBy(*keys, "n_columns", "__column", "__line").agg(joined(F.struct("x0", "top", "text"), " ").alias("text"))
    return lines.groupBy(*keys, "n_columns").agg(joined(F.struct("__column", "__line", "text"), "\n").alias("text"))
