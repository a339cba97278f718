"""Landed records: raw JSON bytes become typed columns by a contract of field names; listing pages become candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.text import each

#: Our fields, the provider's names for them, and their kinds.
CONTRACT = {
    "source_ref": ("slug", "text"), "sygnatura_glowna": ("primary_signature", "text"), "sygnatury": ("signatures", "list"), "data_wydania": ("ruling_date", "text"),
    "data_rozprawy": ("hearing_date", "text"), "rodzaj": ("ruling_kind", "text"), "rozstrzygniecie": ("outcome", "text"), "rozstrzygniecie_surowe": ("outcome_raw", "text"),
    "przewodniczacy": ("chairperson", "text"), "odwolujacy": ("appellant_raw", "text"), "zamawiajacy": ("procuring_entity_raw", "text"), "przepisy": ("law_articles", "list"),
    "koszty": ("costs_total", "number"), "url_zrodla": ("source_url", "text"), "tresc": ("full_text", "body"),
}


def _field(name: str, kind: str) -> Column:
    """One field of the variant _v, strictly by its kind: numbers never become text, nor text numbers; blank text is null; lists keep text that isn't blank."""
    own = F.variant_get("_v", f"$.{name}", "variant")
    kind_of = F.schema_of_variant(own)
    if kind == "number":
        return F.when(kind_of.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get("_v", f"$.{name}", "double"))
    if kind == "list":
        items = F.try_variant_get("_v", f"$.{name}", "array<variant>")
        texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
        return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))
    text = F.when(kind_of == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))
    return text if kind == "body" else F.nullif(F.trim(text), F.lit(""))


def decode(landed: DataFrame, content: str = "content", contract: dict = CONTRACT) -> DataFrame:
    """landed with decoded (whether the bytes are a JSON object) and the contract's fields; fields that it doesn't name go. An empty list of case numbers falls back to the main one.
    Rows that can't be decoded stay, with null fields, so they are counted."""
    value = F.try_parse_json(F.try_validate_utf8(F.col(content).cast("binary").cast("string")))
    rows = landed.withColumn("_v", F.when(F.schema_of_variant(value).startswith("OBJECT"), value))
    fields = {ours: F.when(F.col("_v").isNotNull(), _field(name, kind)) for ours, (name, kind) in contract.items()}
    rows = rows.withColumn("decoded", F.col("_v").isNotNull()).withColumns(fields).drop("_v")
    if "sygnatury" in contract and "sygnatura_glowna" in contract:
        main = F.when(F.col("sygnatura_glowna").isNotNull(), F.array("sygnatura_glowna")).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("sygnatury", F.when(F.size("sygnatury") == 0, main).otherwise(F.col("sygnatury")))
    return rows


def candidates(pages: DataFrame, page: str = "page", body: str = "body") -> DataFrame:
    """page, idx, source_ref, sygnatury, data_wydania, good of the records of listing pages; a record without a slug isn't good. Text dates only."""
    rows = each(pages.select(page, F.try_parse_json(F.col(body)).alias("_p")), [page], F.try_variant_get("_p", "$.data", "array<variant>"), "_v", "idx")
    slug, numbers, main = _field("slug", "text"), _field("signatures", "list"), _field("primary_signature", "text")
    both = F.when(F.size(numbers) > 0, numbers).when(main.isNotNull(), F.array(main)).otherwise(F.array().cast("array<string>"))
    return rows.select(page, "idx", slug.alias("source_ref"), both.alias("sygnatury"), _field("ruling_date", "text").alias("data_wydania"), slug.isNotNull().alias("good"))


def first_candidates(rows: DataFrame, most: int, page: str = "page") -> DataFrame:
    """The first candidates in the order of the list."""
    return rows.filter("good").orderBy(page, "idx").limit(most)


def page_checks(pages: DataFrame, most_pages: int, page: str = "page", body: str = "body") -> DataFrame:
    """One row: pages, those whose has_more isn't true or false, and whether the list runs past most_pages."""
    value = F.try_parse_json(F.col(body))
    flag = F.schema_of_variant(F.variant_get(value, "$.has_more", "variant"))
    return pages.agg(F.count("*").alias("pages"), F.count_if(~F.coalesce(flag == "BOOLEAN", F.lit(False))).alias("bad_flags"), (F.max(page) > most_pages).alias("runaway"))
