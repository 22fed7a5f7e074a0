"""Posts of WordPress services and stored list rows, as items and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.html import unescaped
from docketry.functions.text import collapse


def wordpress_items(posts: DataFrame, endpoint: str, template: str | None = None, rewrite: tuple[str, str] | None = None, categories: dict[str, str] | None = None, default: str | None = None) -> DataFrame:
    """external_id, url, title, day, category and version_key of posts (id, slug, link, title, date, modified, categories).

    ``template`` makes addresses of ``{slug}`` and ``{id}``; otherwise the prefix
    ``rewrite[0]`` of a link becomes ``rewrite[1]``.  The first of a post's
    categories that is mapped counts.
    """
    number, link = F.col("id").cast("string"), F.coalesce("link", F.lit(""))
    if template:
        link = F.replace(F.replace(F.lit(template), F.lit("{slug}"), F.coalesce("slug", F.lit(""))), F.lit("{id}"), number)
    elif rewrite:
        link = F.when(F.startswith(link, F.lit(rewrite[0])), F.concat(F.lit(rewrite[1]), F.substring(link, F.lit(len(rewrite[0]) + 1), F.length(link)))).otherwise(link)
    category = F.lit(default).cast("string")
    if categories:
        names = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
        found = F.filter(F.transform("categories", lambda c: F.try_element_at(names, c.cast("string"))), lambda c: c.isNotNull())
        category = F.coalesce(F.try_element_at(found, F.lit(1)), category)
    return posts.select(
        F.concat(F.lit(f"{endpoint}:"), number).alias("external_id"),
        link.alias("url"),
        collapse(unescaped("title")).alias("title"),
        F.substring("date", 1, 10).try_cast("date").alias("day"),
        category.alias("category"),
        F.col("modified").alias("version_key"),
    )


def listing_text(body: str | Column) -> Column:
    """The text of a stored list row (JSON): title, summary, then ``name: value`` of its plain extras by name.

    Objects, lists and nulls among the extras are left out; what isn't JSON gives null.
    """
    v = F.try_parse_json(F.col(body) if isinstance(body, str) else body)
    get = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    extras = F.map_entries(F.try_variant_get(v, "$.extra", "map<string, variant>"))

    def plain(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), None).otherwise(F.concat(e["key"], F.lit(": "), F.try_variant_get(e["value"], "$", "string")))

    lines = F.concat(F.array(get("$.title"), get("$.summary")), F.coalesce(F.transform(extras, plain), F.array().cast("array<string>")))
    return F.when(v.isNotNull(), F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n"))
