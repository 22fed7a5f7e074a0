"""What people found by hand, held against what the engine has: matches, outcomes, reports, evaluation sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.similarity import Parts, Searched, partial, token_set
from docketry.functions.text import canonical_url, issuers_compatible, parse_date, punctuation_fold
from docketry.session import shuffled, staged

from . import candidates, tiles

#: Least likeness of titles and of texts, days around a detection, words of a title that says little.
LEAST_TITLE, LEAST_TEXT, WINDOW, GENERIC_WORDS = 85.0, 65.0, 7, 4
#: The letters that a text has at least, and the days that a publication may lie from a detection.
LEAST_NEEDLE, EARLIEST, LATEST = 60, -14, 2


def normal_rows(rows: DataFrame) -> DataFrame:
    """Imported rows (row, day, units as text) with day as a date and units as a list."""
    day = F.coalesce(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date"), parse_date("day"))
    units = F.filter(F.split(F.coalesce("units", F.lit("")), r"\s*[;,]\s*"), lambda u: u != "")
    return rows.select("row", day.alias("day"), units.alias("units"))


def reference_issuer(value: Column, title: Column, names: dict[str, str], others: dict[str, str]) -> Column:
    """The issuer's code: its own, that of its name, or the first that the title speaks of."""
    upper = F.upper(F.trim(value))
    own = F.when(upper.isin(*names), upper)
    named = reduce(lambda c, x: c.when(upper == x[1].upper(), x[0]), names.items(), F.when(F.lit(False), ""))
    told = reduce(lambda c, x: c.when(F.coalesce(title, F.lit("")).rlike(x[0]), x[1]), others.items(), F.when(F.lit(False), ""))
    return F.coalesce(own, named, told)


def _rest(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(shuffled(found.select("row")), "row", "left_anti")


def _one(found: DataFrame, method: str, *more: str) -> DataFrame:
    """Of several publications the linked one, then the best, then the smallest id."""
    best = F.min(F.struct(F.col("reg_id").isNull().alias("loose"), (-F.col("score")).alias("worse"), "doc_id", "reg_id", *more))
    return found.groupBy("row").agg(best.alias("x")).select("row", F.col("x.doc_id").alias("doc_id"), F.col("x.reg_id").alias("reg_id"), F.round(-F.col("x.worse"), 2).alias("score"), F.lit(method).alias("method"), *[F.col(f"x.{c}").alias(c) for c in more])


def _first_of(publications: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``: its linked publication of the smallest id, or without one the smallest."""
    best = F.min(F.struct(F.col("reg_id").isNull().alias("loose"), "doc_id", "reg_id"))
    return publications.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col("x.doc_id").alias("doc_id"), F.col("x.reg_id").alias("reg_id"))


def _by_key(rows: DataFrame, publications: DataFrame, keys: list[str], method: str) -> DataFrame:
    """The publication of each row with the same keys.  It is the same one for all rows of a key, so a key is settled before rows meet it."""
    known = [df.dropna(subset=keys) for df in (rows, publications)]
    return _one(shuffled(known[0]).join(_first_of(known[1], keys), keys).withColumn("score", F.lit(100.0)), method)


def _title_tile(least: float, window: int):
    def pairs(left: list, right: list, same: bool) -> Iterator[tuple[int, int, int | None, float]]:
        a, b = candidates.Titles(left), candidates.Titles(right)
        near = np.abs(a.days[:, None] - b.days[None]) <= window
        fit = near & candidates.issuers_fit(a, b)[0] & (100 * candidates.title_bound(a, b) >= least - 1e-9)
        known: dict[tuple[str, str], float] = {}
        for i, j in zip(*(x.tolist() for x in np.nonzero(fit)), strict=True):
            key = a.joined[i], b.joined[j]
            if key not in known:
                known[key] = token_set(a.titles[i], b.titles[j])
            if known[key] >= least:
                yield int(a.ids[i]), int(b.ids[j]), right[j]["reg_id"], known[key]

    return pairs


def _sides(rows: DataFrame, publications: DataFrame, width: int, chunk: int, **facts: Column) -> tuple[tiles.Side, tiles.Side]:
    """Dated rows and publications in chunks: the id (row or doc_id), day, issuer, reg_id, and ``facts``."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day")
    found = []
    for df, own, name in ((rows, "row", "rows"), (publications, "doc_id", "pubs")):
        reg = F.col("reg_id") if "reg_id" in df.columns else F.lit(None).cast("long")
        r = F.struct(F.col(own).cast("long").alias("doc_id"), reg.alias("reg_id"), day, "issuer", *[c.alias(k) for k, c in facts.items()])
        found.append(tiles.Side(df.where("day is not null").select(tiles.window_of(F.col("day"), width).alias("w"), F.col(own).cast("long").alias("key"), r.alias("r")), name, chunk))
    return found[0], found[1]


def near_titles(rows: DataFrame, publications: DataFrame, least: float = LEAST_TITLE, window: int = WINDOW, chunk: int = 512) -> DataFrame:
    """(row, doc_id, reg_id, score) of rows and publications of compatible issuers within ``window`` days, titles at least ``least`` alike.

    All such pairs, compared tile by tile; rows and publications without a day or a title have none.
    """
    titled = [df.where("length(title_key) > 0") for df in (rows, publications)]
    left, right = _sides(*titled, width=window, chunk=chunk, title=F.col("title_key"))
    return tiles.compare(left, right, range(-1, 2), _title_tile(least, window), "row long, doc_id long, reg_id long, score double")


def _alike_tile(least: float):
    def pairs(left: list, right: list, same: bool) -> Iterator[tuple[str, str, float]]:
        a, b = candidates.Titles(left), candidates.Titles(right)
        fit = 100 * candidates.title_bound(a, b) >= least - 1e-9
        for i, j in zip(*(x.tolist() for x in np.nonzero(fit)), strict=True):
            found = token_set(a.titles[i], b.titles[j])
            if found >= least:
                yield a.titles[i], b.titles[j], found

    return pairs


def _alike(rows: DataFrame, publications: DataFrame, least: float, window: int, chunk: int) -> DataFrame:
    """(title_key, like, score): titles of rows and of publications of nearby days that are alike, each two once."""
    sides = []
    for df, name in ((rows, "row-titles"), (publications, "pub-titles")):
        titles = df.select(tiles.window_of(F.col("day"), window).alias("w"), "title_key").distinct()
        r = F.struct(F.xxhash64("title_key").alias("doc_id"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("string").alias("issuer"), F.col("title_key").alias("title"))
        sides.append(tiles.Side(titles.select("w", F.col("title_key").alias("key"), r.alias("r")), name, chunk))
    found = tiles.compare(*sides, range(-1, 2), _alike_tile(least), "title_key string, like string, score double")
    return staged(found.distinct(), "alike")


def best_titles(rows: DataFrame, publications: DataFrame, least: float = LEAST_TITLE, window: int = WINDOW, chunk: int = 512) -> DataFrame:
    """row, doc_id, reg_id, score, method, title_key: of all pairs of :func:`near_titles` the best one of each row.

    Equal titles are compared once a window of days, and rows of one title,
    issuer and day settle together; of the publications of a title, issuer and
    day only the one that counts goes on.  Work grows with the square of the
    different titles of a window of days.
    """
    kind = ["title_key", "issuer", "day"]
    rows, publications = (df.where("length(title_key) > 0 AND day is not null") for df in (rows, publications))
    kinds = staged(rows.select(*kind).distinct(), "kinds")
    like = _alike(kinds, publications, least, window, chunk)
    wanted = publications.join(like.select(F.col("like").alias("title_key")).distinct(), "title_key", "left_semi")
    firsts = staged(_first_of(wanted, kind).select(F.col("title_key").alias("like"), F.col("issuer").alias("of"), F.col("day").alias("at"), "doc_id", "reg_id"), "firsts")
    days = F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda n: F.date_add("day", n)))
    met = kinds.join(shuffled(like), "title_key").withColumn("at", days).join(shuffled(firsts), ["like", "at"]).where(issuers_compatible(F.col("issuer"), F.col("of")))
    best = F.min(F.struct(F.col("reg_id").isNull().alias("loose"), (-F.col("score")).alias("worse"), "doc_id", "reg_id", "like"))
    best = staged(met.groupBy(*kind).agg(best.alias("x")), "best-titles")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in kind]
    told = rows.alias("r").join(shuffled(best).alias("b"), same[0] & same[1] & same[2]).select("row", "x.*").withColumn("score", -F.col("worse"))
    return _one(told, "title", "like").withColumnRenamed("like", "title_key")


def _text_tile(least: float):
    def pairs(left: list, right: list, same: bool) -> Iterator[tuple[int, int, int | None, float]]:
        known: dict[tuple[str, str], float] = {}
        # The rows of a publication's days and issuer, and which of them a body can hold.
        near: dict[tuple[int, str | None], tuple[int, ...]] = {}
        bodies: dict[tuple[int, ...], list[str]] = {}
        for b in right:
            kind = b["day"], b["issuer"]
            if kind not in near:
                near[kind] = tuple(k for k, a in enumerate(left) if EARLIEST <= b["day"] - a["day"] <= LATEST and candidates.compatible(a["issuer"], b["issuer"]))
            bodies.setdefault(near[kind], []).append(b["body"])
        fits: dict[tuple[tuple[int, ...], str], list[int]] = {}
        for own, texts in bodies.items():
            texts = list(dict.fromkeys(texts))
            found = Parts([left[k]["needle"] for k in own], least).fits(texts)
            fits.update(((own, body), np.flatnonzero(fit).tolist()) for body, fit in zip(texts, found, strict=True))
        for b in right:
            own, body = near[b["day"], b["issuer"]], b["body"]
            searched = None
            for k in fits[own, body]:
                a = left[own[k]]
                key = a["needle"], body
                if key not in known:
                    searched = searched or Searched(body)
                    known[key] = partial(*key, least, searched)[0]
                if known[key] >= least:
                    yield a["doc_id"], b["doc_id"], b["reg_id"], known[key]

    return pairs


def near_texts(rows: DataFrame, publications: DataFrame, least: float = LEAST_TEXT, chunk: int = 512) -> DataFrame:
    """(row, doc_id, reg_id, score): a row's text inside a publication's, from 14 days before to 2 after, at least ``least`` alike.

    Texts are compared whole, as words in lower case without marks; a row's has to
    have 60 letters at least.  All pairs within the days are compared, tile by
    tile; equal texts once a tile, and exactly only where a bound for all rows at
    once (:class:`Parts`) lets them.
    """
    folded = punctuation_fold("text")
    rows = rows.withColumn("_needle", folded).where(F.length("_needle") >= LEAST_NEEDLE).withColumn("_body", F.lit(None).cast("string"))
    publications = publications.withColumn("_body", folded).where("length(_body) > 0").withColumn("_needle", F.lit(None).cast("string"))
    left, right = _sides(rows, publications, width=LATEST - EARLIEST, chunk=chunk, needle=F.col("_needle"), body=F.col("_body"))
    return tiles.compare(left, right, range(-1, 2), _text_tile(least), "row long, doc_id long, reg_id long, score double")


def match_rows(rows: DataFrame, publications: DataFrame) -> DataFrame:
    """Each row's publication: by address, by number of decision, by title, by text; every rung sees what those before left.

    ``rows``: row, url, issuer, number, day, title_key, text; ``publications``:
    doc_id, reg_id (null if not linked), url, issuer, number, day, title_key,
    text.  A title of few words stands in many others, so where a text of another
    record is alike as well, that one counts.
    """
    keyed = [df.where("url is not null").withColumn("key", canonical_url("url")) for df in (rows, publications)]
    by_url = staged(_by_key(*keyed, ["key"], "url"), "by-url")
    rest = staged(_rest(rows, by_url), "rest")
    by_key = staged(_by_key(rest, publications, ["issuer", "number"], "number"), "by-number")
    rest = staged(_rest(rest, by_key), "rest")
    titled = staged(best_titles(rest, publications), "by-title")
    by_title = titled.drop("title_key")
    short = titled.where(F.size(F.split("title_key", " ")) <= GENERIC_WORDS).select("row")
    unsure = _rest(rest, by_title).unionByName(rest.join(shuffled(short), "row", "left_semi"))
    by_text = staged(_one(near_texts(unsure, publications), "text"), "by-text")
    # A text replaces a title only by another record.
    other = by_text.join(shuffled(by_title.select("row", F.col("reg_id").alias("own"), F.lit(True).alias("titled"))), "row", "left")
    by_text = other.where(F.col("titled").isNull() | (F.col("reg_id").isNotNull() & ~F.col("reg_id").eqNullSafe(F.col("own")))).select(*by_text.columns)
    found = reduce(DataFrame.unionByName, (by_url, by_key, _rest(by_title, by_text), by_text))
    return rows.select("row").join(shuffled(found), "row", "left")


def _seen_around(asked: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """``asked`` (issuer, number, day) with what ``days`` (issuer, number, day, docs, low, high) hold within ``window`` days.

    Days are cut into blocks as long as what is asked for, which therefore lies
    in the end of one block and the start of the next: running values in both
    directions answer it, and no day meets all others.
    """
    keys, width = ["issuer", "number"], 2 * window + 1
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("docs", "boolean"), ("low", "long"), ("high", "long"))]
    marks = days.select(*keys, number.alias("x"), F.lit(None).cast("date").alias("asks"), F.lit(0).alias("end"), "docs", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    for end in (-1, 1):
        marks = marks.unionByName(asked.select(*keys, (number + end * window).alias("x"), F.col("day").alias("asks"), F.lit(end).alias("end"), *nothing))
    marks = marks.withColumn("block", F.floor(F.col("x") / width))
    from_ = Window.partitionBy(*keys, "block")
    onward = from_.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    back = from_.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)
    run = lambda w: F.struct(F.bool_or("docs").over(w).alias("docs"), F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))
    told = marks.withColumn("s", F.when(F.col("end") < 0, run(back)).otherwise(run(onward))).where("asks is not null")
    return told.groupBy(*keys, F.col("asks").alias("day")).agg(F.bool_or("s.docs").alias("docs"), F.min("s.low").alias("low"), F.max("s.high").alias("high"))


def reference_match(rows: DataFrame, publications: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, status, reg_id by issuer and number: matched, ambiguous, conflict (other days), unverified (not linked) or none.

    A publication or row without a day is near any.  Publications are summed up a
    day, and rows of one day ask once, so a number of many publications and rows
    isn't multiplied out.
    """
    keys = ["issuer", "number"]
    rows = rows.where("number is not null").select("row", *keys, "day")
    summed = [F.coalesce(F.bool_or(F.col("doc_id").isNotNull()), F.lit(False)).alias("docs"), F.min("reg_id").alias("low"), F.max("reg_id").alias("high")]
    days = staged(publications.dropna(subset=keys).groupBy(*keys, "day").agg(*summed), "days")
    again = lambda kind, where: [F.coalesce(F.bool_or(F.when(where, F.col("docs"))), F.lit(False)).alias(f"docs_{kind}"), F.min(F.when(where, F.col("low"))).alias(f"low_{kind}"), F.max(F.when(where, F.col("high"))).alias(f"high_{kind}")]
    total = days.groupBy(*keys).agg(*again("all", F.lit(True)), *again("any", F.col("day").isNull()))
    asked = rows.dropna(subset=[*keys, "day"]).select(*keys, "day").distinct()
    near = _seen_around(asked, days.where("day is not null"), window)
    met = rows.join(total, keys, "left").join(shuffled(near), [*keys, "day"], "left")
    undated = F.col("day").isNull()
    own = lambda c, join: F.when(undated, F.col(f"{c}_all")).otherwise(join(F.col(c), F.col(f"{c}_any")))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    seen = met.groupBy("row").agg(F.bool_or("docs_all").alias("docs"), F.bool_or(own("docs", either)).alias("near"), F.min(own("low", F.least)).alias("low"), F.max(own("high", F.greatest)).alias("high"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(~yes("docs"), "none").when(~yes("near"), "conflict").when(F.col("low") < F.col("high"), "ambiguous").when(F.col("low").isNotNull(), "matched").otherwise("unverified")
    return seen.select("row", status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("reg_id"))


def review_candidates(pairs: DataFrame, most: int = 5) -> DataFrame:
    """row, place, reg_id, doc_id, score: each candidate record once, with its best document."""
    best = pairs.where("reg_id is not null").groupBy("row", "reg_id").agg(F.min(F.struct((-F.col("score")).alias("worse"), "doc_id")).alias("x"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("x.worse", "reg_id"))
    return best.select("row", place.alias("place"), "reg_id", F.col("x.doc_id").alias("doc_id"), (-F.col("x.worse")).alias("score")).where(F.col("place") <= most)


def key_candidates(rows: DataFrame, publications: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """What :func:`review_candidates` gives for rows and all publications (reg_id, doc_id, score) with the same keys.

    All rows of a key have the same candidates, so they are ranked once a key.
    """
    known = publications.dropna(subset=keys).select(F.struct(*keys).alias("row"), "reg_id", "doc_id", "score")
    best = review_candidates(known, most).withColumnRenamed("row", "key")
    return rows.dropna(subset=keys).select("row", F.struct(*keys).alias("key")).join(best, "key").drop("key")


def outcomes(matches: DataFrame, records: DataFrame, ends: DataFrame) -> DataFrame:
    """row, outcome, final: what became of each detection.

    ``records``: reg_id, status, is_relevant, visible; ``ends`` (reg_id, into):
    where merged records ended up.
    """
    first = records.select("reg_id", F.col("status").alias("own"))
    last = records.select(F.col("reg_id").alias("final"), "status", "is_relevant", "visible")
    both = matches.select("row", "doc_id", "reg_id").join(shuffled(first), "reg_id", "left").join(shuffled(ends), "reg_id", "left").withColumn("final", F.coalesce("into", "reg_id")).join(shuffled(last), "final", "left")
    outcome = F.when(F.col("own").isNull(), F.when(F.col("doc_id").isNotNull(), "not_processed").otherwise("not_collected")).when(F.col("visible"), "detected").when(F.col("own") == "MERGED", "dedupe_lost")
    outcome = outcome.when(F.col("status") == "BASELINE", "baseline").when(~F.col("is_relevant") | (F.col("status") == "IRRELEVANT"), "below_threshold").otherwise("not_processed")
    return both.select("row", outcome.alias("outcome"), F.when(F.col("own").isNotNull(), F.col("final")).alias("final"))


def parallel_report(judged: DataFrame) -> DataFrame:
    """One row over detections (outcome, severity, severity_own, units, units_own, hours): misses, agreement, units, latency."""
    hit = F.col("outcome") == "detected"
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)
    first = F.try_element_at("units_own", F.lit(1))
    return judged.agg(
        F.count("*").alias("n"),
        F.count_if(~hit).alias("missed"),
        share(~hit, F.lit(True)).alias("miss_rate"),
        share(hit & (F.abs(F.col("severity") - F.col("severity_own")) <= 1), hit & F.col("severity_own").isNotNull()).alias("severity_within_1"),
        share(hit & F.array_contains("units", first), hit & (F.size("units") > 0)).alias("unit_top1"),
        share(hit & F.arrays_overlap("units", "units_own"), hit & (F.size("units") > 0)).alias("unit_any"),
        F.round(F.median(F.when(hit, F.col("hours"))), 4).alias("median_hours"),
    )


def missed_by_reason(judged: DataFrame) -> DataFrame:
    return judged.where("outcome <> 'detected'").groupBy("outcome").agg(F.count("*").alias("n"))


def extra_alerts(records: DataFrame, matches: DataFrame, since: str, until: str) -> DataFrame:
    """Visible records of a period that no detection names."""
    within = F.col("publish_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return records.where(F.col("visible") & within).join(matches.select(F.col("final").alias("reg_id")), "reg_id", "left_anti")


def match_state(outcome: Column, candidates: Column) -> Column:
    return F.when(outcome == "not_collected", F.when(candidates > 0, "review").otherwise("unmatched")).when(outcome == "not_processed", "unprocessed").otherwise("matched")


def with_selections(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Matches after people chose otherwise (row, reg_id; null: none of them)."""
    own = chosen.select("row", F.col("reg_id").alias("picked"), F.lit(True).alias("chosen"))
    return matches.join(shuffled(own), "row", "left").select("row", F.when(F.col("chosen"), F.col("picked")).otherwise(F.col("reg_id")).alias("reg_id"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


def control_population(records: DataFrame, excluded: list[DataFrame], since: str, until: str) -> DataFrame:
    """Irrelevant records of a period but those used elsewhere (examples, other sets), so nothing leaks."""
    within = F.col("publish_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return reduce(lambda d, x: d.join(x, x.columns, "left_anti"), excluded, records.where(~F.col("is_relevant") & within))


def evaluation_set(populations: DataFrame, sizes: dict[str, int], seed: str) -> DataFrame:
    """reg_id, stratum, place: of each stratum the first ones by a hash of seed and id, so a sample is repeatable."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "stratum", F.col("reg_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(draw, "reg_id"))
    most = reduce(lambda c, x: c.when(F.col("stratum") == x[0], x[1]), sizes.items(), F.when(F.lit(False), 0))
    return populations.withColumn("place", place).where(F.col("place") <= F.coalesce(most, F.lit(0))).select("reg_id", "stratum", "place")


def stratum_counts(items: DataFrame, strata: list[str]) -> DataFrame:
    """stratum, n, in a fixed order, with those without an item."""
    spine = items.sparkSession.createDataFrame([(s, k) for k, s in enumerate(strata)], "stratum string, place int")
    return spine.join(items.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "left").select("place", "stratum", F.coalesce("n", F.lit(0)).alias("n"))


def experiment_summary(items: DataFrame) -> DataFrame:
    """One row: items, answers that changed, calls answered from the cache, and answers right on either side."""
    right = lambda c: F.count_if(F.col("expected").eqNullSafe(F.col(c)) & F.col("expected").isNotNull())
    return items.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if("cached").alias("cached"), right("a").alias("right_a"), right("b").alias("right_b"))


def comparison_sheets(rows: DataFrame, outcomes: DataFrame, extra: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a comparison: how many rows came out how, every row with its outcome, and visible records that no row names."""
    summary = outcomes.groupBy("outcome").agg(F.count("*").alias("n")).union(extra.agg(F.lit("extra").alias("outcome"), F.count("*").alias("n")))
    return {"summary": summary, "rows": rows.join(outcomes, "row", "left"), "extra": extra}


def experiment_sheets(items: DataFrame, strata: DataFrame) -> dict[str, DataFrame]:
    """The sheets of an experiment: its summary, its strata, and every item with those first whose answers differ."""
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    ordered = items.withColumn("changed", changed).orderBy(F.desc("changed"), "doc_id")
    return {"summary": experiment_summary(items), "strata": strata, "items": ordered}
