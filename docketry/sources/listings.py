"""Reading what publishers list: feeds, JSON services, pages and files of addresses."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.html import page_links, unescaped
from docketry.functions.text import collapse, parse_date, tr_lower
from docketry.functions.tree import CssListing, css_items, outlined, outlines
from docketry.operators.changes import canonical_link, stable_id
from docketry.session import staged


@dataclass(frozen=True)
class JsonListing:
    """Where a JSON service has its items and their fields (dotted paths); ``allow``: values a field may have."""

    items: str
    fields: dict[str, str]
    dates: tuple[str, ...] = ()
    allow: dict[str, tuple[str, ...]] = field(default_factory=dict)


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Publishers (code, name, strategy, url, enabled) in force; codes are told apart without case."""
    frame = spark.createDataFrame(rows, "code string, name string, strategy string, url string, enabled boolean")
    return frame.withColumn("code", F.upper("code")).where("enabled").dropDuplicates(["code"])


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """url, title and day of the entries of RSS or Atom files."""
    schema = "title string, link string, pubDate string, updated string, published string, guid string"
    items = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    url = F.regexp_replace(F.trim(F.coalesce("link", "guid")), "^http://", "https://")
    day = parse_date(F.coalesce("published", "pubDate", "updated"))
    # Titles are often escaped twice.
    return items.select(url.alias("url"), collapse(unescaped(unescaped("title"))).alias("title"), day.alias("day"), F.col("updated").alias("version_key"))


def json_items(bodies: DataFrame, listing: JsonListing) -> DataFrame:
    """One row an item of JSON texts (column body), with the listing's fields and the first date that is there."""
    parsed = bodies.select(F.try_parse_json("body").alias("v"))
    items = parsed.select(F.explode(F.try_variant_get("v", f"$.{listing.items}", "array<variant>")).alias("i"))
    get = lambda path: F.try_variant_get("i", f"$.{path}", "string")
    days = [parse_date(get(p)) for p in listing.dates]
    out = items.select(*[get(p).alias(n) for n, p in listing.fields.items()], (F.coalesce(*days) if days else F.lit(None).cast("date")).alias("day"))
    for name, values in listing.allow.items():
        out = out.where(F.col(name).isin(*values))
    return out


def modified_since(posts: DataFrame, column: str, last_success: Column, overlap_hours: int = 6) -> DataFrame:
    """The posts changed since the last success, less an overlap, from the full hour."""
    return posts.where(F.col(column) >= F.date_trunc("hour", last_success - F.expr(f"interval {overlap_hours} hours")))


def link_items(pages: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """The links of pages (page_id, url, html) whose address fits a pattern, each once a page, with a stable id."""
    links = pages.select("page_id", F.explode(page_links("html", "url")).alias("l")).select("page_id", "l.url", collapse("l.title").alias("title"))
    kept = links.where(F.col("url").rlike(include))
    if exclude:
        kept = kept.where(~F.col("url").rlike(exclude))
    return kept.dropDuplicates(["page_id", "url"]).withColumn("external_id", stable_id(F.col("url"), include))


@dataclass(frozen=True)
class ItemRules:
    """What becomes of an item's texts: patterns for its date and for further fields, what is taken off titles or put before them, and its id."""

    date: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    strip: tuple[str, ...] = ()
    prefix: str = ""
    id_pattern: str | None = None
    id_prefix: str = ""


def selected_items(pages: DataFrame, listing: CssListing, rules: ItemRules = ItemRules()) -> DataFrame:
    """page_id, place, url, external_id, title, day, summary and the rules' fields of the items of pages (page_id, url, html).

    An address that a page names twice counts once, where it stands first.  The
    day is that of the item's date, else of what a pattern finds in its text.
    """
    found = pages.select("page_id", F.posexplode(css_items(F.col("html"), F.col("url"), listing)).alias("n", "i")).select("page_id", "i.*")
    place = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("place"))
    once = found.withColumn("turn", place).where("turn = 1")
    # The first group of a pattern, or all of it if it has none.
    part = lambda pattern: F.nullif(F.regexp_extract("text", f"({pattern})", min(2, 1 + re.compile(pattern).groups)), F.lit(""))
    title = F.col("title")
    for pattern in rules.strip:
        title = F.regexp_replace(title, pattern, "")
    title = collapse(title)
    title = F.when(title != "", F.concat(F.lit(rules.prefix), title)).otherwise(title)
    day = parse_date("date") if listing.date else F.lit(None).cast("date")
    if rules.date:
        day = F.coalesce(day, parse_date(part(rules.date)))
    name = F.coalesce(F.nullif(F.regexp_extract("url", rules.id_pattern, 1), F.lit("")) if rules.id_pattern else F.lit(None), stable_id(F.col("url"), "^()$"))
    name = F.concat(F.lit(rules.id_prefix), name)
    more = [collapse(part(p)).alias(k) for k, p in rules.fields.items()]
    return once.select("page_id", "place", "url", name.alias("external_id"), title.alias("title"), day.alias("day"), "summary", *more)


def listed_until(items: DataFrame, pages: DataFrame, until: Column) -> tuple[DataFrame, DataFrame]:
    """Items of listings read backwards page by page to a day, and whether each listing got there.

    ``pages``: listing, page_id, number.  A listing ends with its first page that
    has an item from before ``until``, or that has no item at all; later pages are
    left out.  The second frame (listing, incomplete) says where neither happened.
    """
    oldest = items.groupBy("page_id").agg(F.min("day").alias("oldest"), F.count("*").alias("n"))
    told = pages.join(oldest, "page_id", "left").withColumn("ends", F.coalesce(F.col("oldest") < until, F.lit(False)) | F.col("n").isNull())
    last = told.groupBy("listing").agg(F.min(F.when(F.col("ends"), F.col("number"))).alias("last"))
    within = pages.join(last, "listing").where(F.col("last").isNull() | (F.col("number") <= F.col("last")))
    return items.join(within.select("page_id", "listing", "number"), "page_id"), last.select("listing", F.col("last").isNull().alias("incomplete"))


def expand_urls(templates: DataFrame, today: Column, overlap_days: int = 15) -> DataFrame:
    """``{year}`` in url as this year, and early in January as the last one too."""
    year = F.year(today)
    years = F.when((F.month(today) == 1) & (F.dayofmonth(today) <= overlap_days), F.array(year, year - 1)).otherwise(F.array(year))
    several = F.when(F.col("url").contains("{year}"), years).otherwise(F.array(year))
    return templates.withColumn("y", F.explode(several)).select(F.replace("url", F.lit("{year}"), F.col("y").cast("string")).alias("url"))


def resolve_items(items: DataFrame) -> DataFrame:
    """External ids by the canonical address, and of rows with the same such id only the first by place."""
    known = canonical_link(F.col("url"))
    named = items.withColumn("known", known).withColumn("external_id", F.coalesce(known, "external_id"))
    place = F.row_number().over(Window.partitionBy("external_id").orderBy("place"))
    return named.withColumn("n", place).where("known is null or n = 1").drop("known", "n")


def host_allowed(url: Column, patterns: list[str]) -> Column:
    """Whether a host fits one of the globs."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(*[F.when(host.rlike(fnmatch.translate(p.lower())), True) for p in patterns], F.lit(False))


def page_number(url: Column, n: int) -> Column:
    """The address of another page; null where none is named."""
    return F.when(url.rlike(r"[?&]page=\d+"), F.regexp_replace(url, r"([?&]page=)\d+", f"$1{n}"))


def carried_sections(rows: DataFrame) -> DataFrame:
    """Each item of an index (page_id, place, header, title) with the last header before it."""
    section = F.last("header", ignorenulls=True).over(Window.partitionBy("page_id").orderBy("place"))
    return rows.withColumn("section", section).where("header is null").drop("header")


#: Where an issue of the gazette has its index, and what stands in it.
GAZETTE_WITHIN, GAZETTE_KINDS = "#html-content", (("section", ".html-title"), ("subtitle", ".html-subtitle"), ("item", ".fihrist-item"))
#: How an issue's texts and notices are addressed, and the section that isn't law.
GAZETTE_ITEM, NOTICES = r"/(?:eskiler|ilanlar/eskiilanlar)/\d{4}/\d{2}/(\d{8}(?:M\d+)?(?:-[\w-]+)?)\.\w+$", "İLÂN BÖLÜMÜ"


def _plain_section(text: Column) -> Column:
    return F.translate(tr_lower(collapse(text)), "â", "a")


def gazette_items(pages: DataFrame, excluded: tuple[str, ...] = (NOTICES,), indexes: tuple[str, ...] = ()) -> DataFrame:
    """issue, place, url, external_id, title, day, category, section, subtitle, role of the texts that issues of the gazette list.

    ``pages``: day, supplement (0: the day's own issue), url, html.  An item
    belongs to the section and subtitle before it.  Items of another issue, as a
    missing supplement shows them, are none; nothing counts after a day's first
    supplement without items.  Of the excluded sections only lists of notices
    named in ``indexes`` are kept, as role ``index``; all others have role ``item``.
    """
    issue = F.concat(F.date_format("day", "yyyyMMdd"), F.when(F.col("supplement") > 0, F.concat(F.lit("M"), F.col("supplement").cast("string"))).otherwise(""))
    own = F.concat(F.lit("/"), F.col("issue"))
    listed = F.regexp_extract("url", r"(/\d{8}(?:M\d+)?)(?:-[\w-]+)?\.\w+$", 1).eqNullSafe(own)
    # Written once, as a page is dear to read and its items are asked for twice; of items only those that count, without their text, which headers alone are asked for.
    lines = outlined(pages.withColumn("issue", issue), ["day", "supplement", "issue"], GAZETTE_KINDS, GAZETTE_WITHIN)
    lines = lines.where((F.col("kind") != "item") | (F.col("url").isNotNull() & listed)).withColumn("text", F.when(F.col("kind") != "item", F.col("text")))
    lines = staged(lines, "outlines")
    # The window is one page's.
    before = Window.partitionBy("issue").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("kind") != "item", F.struct("kind", "text"))
    last = F.last(header, ignorenulls=True).over(before)
    lines = lines.withColumn("section", F.last(F.when(F.col("kind") == "section", collapse("text")), ignorenulls=True).over(before)).withColumn("_last", last)
    lines = lines.withColumn("subtitle", F.when(F.col("_last.kind") == "subtitle", collapse("_last.text")))
    found = lines.where("kind = 'item'")
    # Supplements are numbered on, so one that is empty ends the day.
    there = found.select("day", "supplement").distinct()
    empty = pages.select("day", "supplement").join(there, ["day", "supplement"], "left_anti").groupBy("day").agg(F.min("supplement").alias("_end"))
    found = found.join(empty, "day", "left").where(F.col("_end").isNull() | (F.col("supplement") < F.col("_end")))
    put_out = _plain_section(F.col("section")).isin(*[F.translate(tr_lower(F.lit(x)), "â", "a") for x in excluded]) if excluded else F.lit(False)
    title = collapse("title")
    listed = F.lit(False)
    for name in indexes:
        listed = listed | _plain_section(title).contains(_plain_section(F.lit(name)))
    role = F.when(~F.coalesce(put_out, F.lit(False)), "item").when(listed, "index")
    ident = F.coalesce(F.nullif(F.regexp_extract("url", GAZETTE_ITEM, 1), F.lit("")), "url")
    return found.select("issue", "place", "url", ident.alias("external_id"), title.alias("title"), "day", F.coalesce("subtitle", "section").alias("category"), "section", "subtitle", role.alias("role")).where("role is not null")


def gazette_notices(indexes: DataFrame, pages: DataFrame, issuers: list[str]) -> DataFrame:
    """issue, url, external_id, title, day, issuer: the notices of ``indexes`` (of :func:`gazette_items`) whose issuer fits one of the patterns, in lower case.

    ``pages``: url, html of the lists of notices; an address that a list names twice counts once.
    """
    lists = indexes.where("role = 'index'").select("issue", "day", F.col("title").alias("index_title"), F.col("url").alias("of"))
    both = lists.join(pages.select(F.col("url").alias("of"), "html"), "of")
    links = both.select("issue", "day", "index_title", "of", F.explode(outlines(F.col("html"), F.col("of"), (("a", "a[href]"),))).alias("x")).select("issue", "day", "index_title", "of", "x.*")
    ident, who = F.regexp_extract("url", GAZETTE_ITEM, 1), collapse("text")
    fits = F.lit(False)
    for pattern in issuers:
        fits = fits | tr_lower(who).rlike(f"(?U){pattern}")
    kept = links.where((ident != "") & (who != "") & fits)
    first = F.row_number().over(Window.partitionBy("issue", "of", "url").orderBy("place"))
    kept = kept.withColumn("turn", first).where("turn = 1").withColumn("issuer", F.trim(F.regexp_replace(who, ":+$", "")))
    return kept.select("issue", "url", ident.alias("external_id"), F.concat("issuer", F.lit(" — "), "index_title").alias("title"), "day", "issuer")
