"""What the queries share: registration, the collection in its working form, and the SQL of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.terms import annotation_map
from tidewire.sources.tables import latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ARTICLE = ("hl", "body", "wc", "pub_date", "iptc", "url", "desc_terms", "pred", "ann", "split_name", "source")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = make
        if sql is not None:
            ORACLES[key] = sql
        return make

    return add


def arts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The articles, one row for each id: the one loaded last. Name the columns that are needed; the rest isn't read."""
    return latest(table(spark, folder, "articles"), *(columns or ARTICLE))


def anns(spark: SparkSession, folder: str) -> DataFrame:
    """The annotations, one row for each article and derived key."""
    return annotation_map(table(spark, folder, "annotations"))


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


# --- SQL -------------------------------------------------------------------------------------------------------------------------------------------

SPACE = r"[ \t\n\x0B\f\r]+"
_STRUCT = ", ".join(f"'{c}': {c}" for c in ARTICLE)
ART = f"art as (select id, unnest(r) from (select id, arg_max({{{_STRUCT}}}, loaded_at) r from articles where id is not null group by id))"


def _has(c: str) -> str:
    return f"case when lower(trim({c})) not in ('none', '') then {c} end"


KEY = f"coalesce({_has('fb')}, {_has('wd')}, {_has('db')}, phrase)"
_ORDER = ", ".join(f"{c} desc nulls last" for c in ("loaded_at", "mc", "ann_offset", "phrase", "fb", "wd", "db", "tf_idf"))
ANN = f"ann as (select article_id, term, mc, ann_offset, phrase, fb, wd, db, tf_idf, loaded_at from (select * exclude (w2v), {KEY} term, row_number() over (partition by article_id, {KEY} order by {_ORDER}) rn from annotations where article_id is not null and {KEY} is not null) where rn = 1)"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


LAB = f"lab as (select distinct id, {norm('x')} as label from (select id, unnest(iptc) x from art) where {norm('x')} <> '')"
SIZED = "sized as (select art.*, coalesce(n, 0) n_ann from art left join (select article_id, count(*) n from ann group by 1) on article_id = id)"
WORD = rf"word as (select doc_id, lang, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z$¥€ \t\n\x0B\f\r+]', '', 'g'), '{SPACE}'), lambda x: x <> '') ws from documents where text is not null)"
TERM = f"{WORD}, place as (select doc_id, lang, unnest(ws) term, generate_subscripts(ws, 1) - 1 pos from word), terms as (select doc_id doc, term, count(*) mc, min(pos) \"offset\" from place group by all)"
EMB = f"emb as (select term, max(v) v from (select {KEY} term, w2v v from annotations where w2v is not null) where term is not null and len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 group by term)"
