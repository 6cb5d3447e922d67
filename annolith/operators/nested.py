"""Nested pages: a page row holds an array of advertisements, and each of those arrays of people and groups (PRJ29, 32, 34, 39).

An advertisement is struct<key, band string, box array<int>, people array<struct<key, role, box>>, groups array<struct<key, box>>>.
Everything is an expression over the page's own arrays, so no row moves; only a resolver's answers are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_box(child: Column, parent: Column) -> Column:
    """PRJ39: a box in thousandths of its parent as whole numbers of the parent's frame, halves to even; null without four
    numbers on both sides."""

    def along(i: int) -> Column:
        low, high = F.get(parent, F.lit(i % 2)), F.get(parent, F.lit(i % 2 + 2))
        return F.bround(low + F.get(child, F.lit(i)) / F.lit(1000.0) * (high - low), 0).cast("int")

    four = F.coalesce((F.size(child) == 4) & (F.size(parent) == 4), F.lit(False))
    whole = F.forall(child, lambda x: x.isNotNull()) & F.forall(parent, lambda x: x.isNotNull())
    return F.when(four & whole, F.array(*[along(i) for i in range(4)]))


def resolved(pages: DataFrame, answers: DataFrame, page: str = "page", ads: str = "ads") -> DataFrame:
    """PRJ39: pages whose advertisements take the band and people of an answer (page, key, band, people), if there is one; a
    null band keeps the old one. Answers meet their page as a map with an entry for each advertisement, so two answers to one
    are an error."""
    ad = pages.schema[ads].dataType.elementType
    people = ad["people"].dataType.simpleString()
    entry = F.struct(F.col("key").cast(ad["key"].dataType), F.struct("band", F.col("people").cast(people).alias("people")))
    found = answers.groupBy(F.col(page).alias("_page")).agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    joined = pages.join(found, F.col(page) == F.col("_page"), "left")

    def one(x: Column) -> Column:
        own = F.element_at(F.col("_found"), x["key"])
        changed = x.withField("band", F.coalesce(own["band"], x["band"])).withField("people", F.coalesce(own["people"], F.array().cast(people)))
        return F.when(own.isNotNull(), changed).otherwise(x)

    return joined.withColumn(ads, F.transform(ads, one)).select(*pages.columns)


def normalised(pages: DataFrame, ads: str = "ads", reason: str = "reason") -> DataFrame:
    """PRJ39: pages without advertisements of band "0"; the others stand in the order of their upper edge (ties as they stood),
    are numbered ad_1, ad_2, ..., and their people and groups have ids of that number and boxes of the page. Adds dropped and
    qualifying; a page without advertisements keeps its reason or gets ``ads_present_no_visible_faces``, others have none.

    A child keeps its number in its list; without a box it has no id.
    """
    kept = F.filter(F.coalesce(F.col(ads), F.array().cast(pages.schema[ads].dataType)), lambda x: ~x["band"].eqNullSafe(F.lit("0")))
    placed = F.transform(kept, lambda x, i: F.struct(F.coalesce(F.get(x["box"], F.lit(1)), F.lit(1 << 30)).alias("top"), i.alias("at"), x.alias("ad")))
    # arrays of equal edges and distinct places: the rest of the struct never decides
    order = F.array_sort(placed, lambda a, b: F.when(a["top"] != b["top"], F.signum(a["top"] - b["top"])).otherwise(F.signum(a["at"] - b["at"])).cast("int"))

    def child(kind: str, name: Column, box: Column):
        def one(x: Column, i: Column) -> Column:
            own = mapped_box(x["box"], box)
            fits = F.coalesce((F.get(own, F.lit(0)) < F.get(own, F.lit(2))) & (F.get(own, F.lit(1)) < F.get(own, F.lit(3))), F.lit(False))
            return x.withField("box", own).withField("id", F.when(fits, F.concat(name, F.lit(f"_{kind}_"), (i + 1).cast("string"))))

        return one

    def ad(entry: Column, i: Column) -> Column:
        x, name = entry["ad"], F.concat(F.lit("ad_"), (i + 1).cast("string"))
        out = x.withField("id", name)
        for kind, field in (("person", "people"), ("group", "groups")):
            out = out.withField(field, F.transform(x[field], child(kind, name, x["box"])))
        return out

    made = pages.withColumn("dropped", F.coalesce(F.size(F.filter(ads, lambda x: x["band"] == "0")), F.lit(0))).withColumn(ads, F.transform(order, ad))
    n = F.size(ads)
    return made.withColumn("qualifying", n).withColumn(reason, F.when(n == 0, F.coalesce(F.nullif(F.col(reason), F.lit("")), F.lit("ads_present_no_visible_faces"))))


def findings(records: DataFrame, source: str = "source", version: str = "version", ads: str = "ads", reason: str = "reason", old: str = "1.15") -> DataFrame:
    """PRJ29: source, field, value, note: what in records of an older form needs review. A row for each finding, in one pass.

    records: source, version, reason, qualifying (count), ads with groups that have a ``kind``.
    """
    note = lambda ok, field, value, text: F.filter(F.array(F.when(ok, F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(text).alias("note")))), lambda x: x.isNotNull())
    of_version = note(F.col(version) == old, "flow_schema_version", old, "accepted; newer fields may be missing")
    no_reason = note((F.col("qualifying") == 0) & (F.coalesce(F.col(reason), F.lit("")) == ""), "page.no_qualifying_ad_reason", "missing", "old zero-face page needs a reason")
    kinds = F.flatten(F.transform(ads, lambda x: F.transform(F.coalesce(x["groups"], F.array().cast(records.schema[ads].dataType.elementType["groups"].dataType)), lambda g: g["kind"])))
    notes = {"audience_or_crowd": "deprecated; review and recode", "general_crowd": "compared as other_group; raw value kept"}
    hits = F.filter(kinds, lambda k: k.isin(*notes))
    text = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])
    of_group = F.transform(hits, lambda k: F.struct(F.lit("group_type").alias("field"), k.alias("value"), F.element_at(text, k).alias("note")))
    return records.select(source, F.inline(F.concat(of_version, no_reason, F.coalesce(of_group, F.array().cast("array<struct<field string, value string, note string>>")))))


def allowed(metadata: Column, keys: list[str]) -> Column:
    """PRJ32: a map's entries of the allowed keys, without null values."""
    return F.map_filter(metadata, lambda k, v: k.isin(*keys) & v.isNotNull())


def renormalised(rows: DataFrame, ok: str, raw: str, made: str, normal: Column) -> DataFrame:
    """PRJ34: the derived column made anew from the raw one of rows that are ok and have one; the raw column and all other
    rows stay as they are."""
    again = F.coalesce(F.col(ok), F.lit(False)) & F.col(raw).isNotNull()
    return rows.withColumn(made, F.when(again, normal).otherwise(F.col(made)))


def by_pdf_page(rows: DataFrame, identifier: str, order: str) -> DataFrame:
    """SRC22: rows with pdf_page (the identifier's last four digits after a dash, plus 1) and position, in page order; rows
    without such an identifier go."""
    from .tables import numbered

    page = F.try_to_number(F.nullif(F.regexp_extract(identifier, r"-(\d{4})$", 1), F.lit("")), F.lit("9999"))
    placed = rows.withColumn("pdf_page", (page + 1).cast("int")).where("pdf_page is not null")
    return numbered(placed, [F.col("pdf_page"), F.col(order)])
