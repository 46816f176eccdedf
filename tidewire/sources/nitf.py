"""News articles in NITF markup. Files are read whole, each is one row; parsing is Python, an Arrow batch at a time, as paths into nested markup with defaults go beyond XPath."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import word_total

# Names of the meta elements and the fields they fill.
META = {
    "alternate_url": "alternate_url", "author_biography": "author_biography", "banner": "banner", "correction_date": "correction_date", "correction_text": "correction_text",
    "dsk": "news_desk", "feature_page": "feature_page", "online_sections": "online_section", "print_column": "column_number", "print_page_number": "page",
    "print_section": "section", "publication_day_of_month": "publication_day_of_month", "publication_day_of_week": "day_of_week",
    "publication_month": "publication_month", "publication_year": "publication_year", "series_name": "series_name", "slug": "slug",
}
#: Classified content: element, and the kind of service that named it.
LISTS = ("descriptors", "online_descriptors", "general_online_descriptors", "taxonomic_classifiers", "types_of_material", "names", "locations", "online_locations", "organizations", "online_organizations", "people", "online_people", "titles", "online_titles")
TEXTS = ("article_id", "headline", "online_headline", "byline", "normalized_byline", "dateline", "kicker", "lead_paragraph", "online_lead_paragraph", "article_abstract", "body", "credit", "copyright", "publication_date", "url", "word_count", "source_file", "error", *sorted(set(META.values())))
SCHEMA = ", ".join([f"{c} string" for c in TEXTS] + [f"{c} array<string>" for c in LISTS])


def _text(node: ET.Element | None) -> str | None:
    text = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return text or None


def _block(node: ET.Element | None) -> str | None:
    """Paragraphs, a line each; none are null."""
    if node is None:
        return None
    return "\n".join(t for p in node.iter("p") if (t := _text(p))) or None


def _list(kind: str, online: bool, classifier: str | None) -> str | None:
    """The list that an element of identified content goes to."""
    if kind == "classifier":
        return {None: None, "descriptor": "online_descriptors" if online else "descriptors", "general_descriptor": "general_online_descriptors", "taxonomic_classifier": "taxonomic_classifiers", "types_of_material": "types_of_material", "names": "names"}.get(classifier)
    stem = {"location": "locations", "org": "organizations", "person": "people", "object.title": "titles"}.get(kind)
    return stem and (f"online_{stem}" if online else stem)


def parse(text: str | None) -> dict:
    """The fields of a document; one that can't be read has only ``error``. A document type line is dropped, nothing is loaded from elsewhere."""
    out: dict = dict.fromkeys(TEXTS) | {c: [] for c in LISTS}
    if not text:
        return out | {"error": "empty"}
    start = text.find("<!DOCTYPE")
    if start >= 0:
        text = text[:start] + text[text.find(">", start) + 1 :]
    try:
        root = ET.fromstring(text.encode())
    except (ET.ParseError, ValueError) as e:
        return out | {"error": str(e)[:200]}
    for node in root.iter():
        kind, get = node.tag, node.get
        if kind == "meta" and get("name") in META:
            out[META[get("name")]] = get("content")
        elif kind == "doc-id":
            out["article_id"] = get("id-string")
        elif kind == "doc.copyright":
            out["copyright"] = get("holder")
        elif kind == "series":
            out["series_name"] = get("series.name")
        elif kind == "pubdata":
            out |= {"publication_date": get("date.publication"), "url": get("ex-ref"), "word_count": get("item-length")}
        elif kind in ("classifier", "location", "org", "person", "object.title"):
            online = get("class") == "online_producer"
            name, value = _list(kind, online, get("type")), _text(node)
            if name and value:
                out[name].append(value)
        elif kind == "hl1":
            out["headline"] = _text(node)
        elif kind == "hl2" and get("class") == "online_headline":
            out["online_headline"] = _text(node)
        elif kind == "byline":
            out["normalized_byline" if get("class") == "normalized_byline" else "byline"] = _text(node)
        elif kind == "dateline":
            out["dateline"] = _text(node)
        elif kind == "abstract":
            out["article_abstract"] = _block(node) or _text(node)
        elif kind == "block" and get("class") in ("lead_paragraph", "online_lead_paragraph", "full_text", "correction_text"):
            field = {"full_text": "body"}.get(get("class"), get("class"))
            out[field] = _block(node)
        elif kind == "tagline":
            out["author_biography"] = _text(node)
    return out


def parsed(texts: DataFrame, column: str = "value", source: str | None = None) -> DataFrame:
    """Documents of a column of markup, a row for each; ``source_file`` is another column's text if one is named."""
    rows = texts.select(F.col(column).cast("string").alias("x"), (F.col(source) if source else F.lit(None)).cast("string").alias("s"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [parse(x) | {"source_file": s} for x, s in zip(batch["x"], batch["s"], strict=True)]
            yield pd.DataFrame(made, columns=[*TEXTS, *LISTS])

    return rows.mapInPandas(go, SCHEMA)


def read(spark: SparkSession, path: str, pattern: str = "*.xml", count: int | None = None) -> DataFrame:
    """Documents of all files below a folder whose names match; count: the first so many by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.decode("content", "UTF-8").alias("value"))
    return parsed(files.orderBy("path").limit(count) if count is not None else files, "value", "path")


def to_articles(documents: DataFrame) -> DataFrame:
    """Articles (id, hl, body, wc, date, iptc, url, desc, pred): the headline falls back to the online one, the word count to the words of the body, then 0; the date is text of epoch milliseconds; desc is every descriptor, lower-cased."""
    time = F.try_to_timestamp("publication_date", F.lit("yyyyMMdd'T'HHmmss"))
    last = F.transform("taxonomic_classifiers", lambda x: F.substring_index(x, "/", -1))
    desc = F.array_distinct(F.transform(F.concat("descriptors", "online_descriptors", "general_online_descriptors", last), F.lower))
    empty = F.array().cast("array<string>")
    wc = F.coalesce(F.col("word_count").try_cast("int"), word_total(F.col("body")), F.lit(0))
    return documents.where("error is null").select(F.col("article_id").alias("id"), F.coalesce("headline", "online_headline").alias("hl"), "body", wc.alias("wc"), F.unix_millis(time).cast("string").alias("date"), empty.alias("iptc"), "url", F.array_sort(desc).alias("desc"), empty.alias("pred"))


def pretty(documents: DataFrame) -> DataFrame:
    """(article_id, text): a line for each field that is filled, its name in 45 columns."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.rpad(F.lit(c), 45, " "), F.col(c))) for c in TEXTS]
    lines += [F.when(F.size(c) > 0, F.concat(F.rpad(F.lit(c), 45, " "), F.array_join(c, "; "))) for c in LISTS]
    return documents.select("article_id", F.concat_ws("\n", *lines).alias("text"))
