"""Terms of texts and annotations: counts, document frequencies, TF-IDF, vocabulary filters.

The working form of a collection is one row for each document and term: (doc, term, mc, offset). Terms of a text are counted within its row, and the text's number of tokens goes
along, so that nothing is shuffled by document; the only shuffle of the rows is by term, where they meet the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import strip_token, tokens
from tidewire.sources.tables import derived_key


def annotation_map(annotations: DataFrame) -> DataFrame:
    """One row for each article and derived key, as a map by key holds it: (article_id, term, loaded_at, mc, ann_offset, phrase, fb, wd, db, tf_idf).

    Of several rows the one loaded last holds; rows that tie are taken by the greatest values. Rows without an article or key are left out.
    """
    key = derived_key(*(F.col(c) for c in ("fb", "wd", "db", "phrase")))
    row = F.max(F.struct("loaded_at", "mc", "ann_offset", "phrase", "fb", "wd", "db", "tf_idf")).alias("row")
    rows = annotations.withColumn("term", key).where("article_id is not null and term is not null")
    return rows.groupBy("article_id", "term").agg(row).select("article_id", "term", "row.*")


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): words between white space without their other signs; empty ones don't count."""
    words = texts.select(F.explode(F.split(text, r"\s+")).alias("word")).select(strip_token(F.col("word")).alias("token"))
    return words.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def text_terms(texts: DataFrame, doc: str, text: str, stem: bool = False, totals: bool = False) -> DataFrame:
    """(doc, term, mc, offset): a text's tokens with their number and the place of the first; null texts have none. A row is a document. totals: with a column total, the number of the text's tokens.

    Counted in the row: the tokens are sorted with their places, and each run of a token is one term.
    """
    column = tokens(F.col(text))
    if stem:
        from tidewire.functions.stemmer import stem_all

        column = stem_all(column)
    held = texts.select(F.col(doc).alias("doc"), column.alias("_t"))
    held = held.select("doc", F.sort_array(F.transform("_t", lambda t, i: F.struct(t.alias("term"), i.alias("offset")))).alias("_s"))
    held = held.select("doc", "_s", F.expr("filter(transform(_s, (x, i) -> if(i = 0 or x.term <> _s[i - 1].term, i, -1)), i -> i >= 0)").alias("_at"))
    held = held.select("doc", F.size("_s").cast("long").alias("total"), F.expr("transform(_at, (i, j) -> struct(_s[i].term as term, cast(if(j + 1 < size(_at), _at[j + 1], size(_s)) - i as bigint) as mc, _s[i].offset as offset))").alias("_x"))
    more = ["total"] if totals else []
    # the outer form, as of a plain explode the optimiser makes a filter that sorts the tokens once for each of them
    rows = held.select("doc", *more, F.explode_outer("_x").alias("_x")).where("_x is not null")
    return rows.select("doc", "_x.term", "_x.mc", "_x.offset", *more)


def document_frequency(rows: DataFrame, doc: str, term: str, threshold: int = 0) -> DataFrame:
    """(term, df) of terms in more than ``threshold`` documents - strictly more. Rows are one for each document and term."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("df")).where(F.col("df") > threshold)


def frequent_terms(rows: DataFrame, doc: str, term: str, threshold: int) -> DataFrame:
    """Terms in more than ``threshold`` documents, in order."""
    return document_frequency(rows, doc, term, threshold).orderBy("term")


def vocabulary_filter(rows: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """Rows whose term is in the vocabulary; documents left without rows vanish. Catalyst broadcasts a small vocabulary and shuffles a large one."""
    return rows.join(vocabulary.select(F.col("term").alias(term)), term, "left_semi")


def fit_tfidf(rows: DataFrame, doc: str, term: str, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (term, df) of terms in more than ``threshold`` documents, and a row (documents): how many documents keep a term of it."""
    vocabulary = document_frequency(rows, doc, term, threshold)
    kept = vocabulary_filter(rows.select(doc, F.col(term).alias("term")), vocabulary)
    return vocabulary, kept.agg(F.count_distinct(doc).alias("documents"))


def tfidf(rows: DataFrame, vocabulary: DataFrame, documents: DataFrame, doc: str, term: str, mc: str = "mc", all_terms: bool = True, total: str | None = None) -> DataFrame:
    """rows with tf = mc / sum of mc over the document, idf = ln(documents / df) and their product; terms outside the vocabulary have idf 0.

    all_terms: whether the sum runs over all terms of the document or over those of the vocabulary, which then are all that is left. total: a column that holds the sum over all terms,
    which then goes; without it the sum is a window, which shuffles the rows by document. A document whose sum is 0 has tf 0. documents has one row, so its broadcast is bounded.
    """
    joined = rows.join(vocabulary.withColumnRenamed("term", term), term, "left" if all_terms else "inner").join(F.broadcast(documents))
    whole = F.col(total) if total and all_terms else F.sum(F.col(mc)).over(Window.partitionBy(doc))
    tf = F.coalesce(F.try_divide(F.col(mc).cast("double"), whole), F.lit(0.0))
    idf = F.when(F.col("df").isNull(), 0.0).otherwise(F.log(F.col("documents") / F.col("df")))
    return joined.withColumn("tf", tf).withColumn("idf", idf).withColumn("tf_idf", F.col("tf") * F.col("idf")).drop("df", "documents", *([total] if total else []))


def tf_variants(mc: Column, total: Column, most: Column, df: Column, documents: Column) -> dict[str, Column]:
    """Other weights of term and document: raw and logarithmic frequency, by the greatest one, inverse frequencies plain and smooth."""
    return {
        "tf_simple": mc / total,
        "tf_log": F.when(mc > 0, 1 + F.log(mc)).otherwise(0.0),
        "tf_half": 0.5 + 0.5 * mc / most,
        "idf": F.log(documents / df),
        "idf_smooth": F.log(1 + documents / df),
    }


def top_terms(weighted: DataFrame, group: str, term: str, weight: str, k: int) -> DataFrame:
    """The k terms of greatest weight in each group; ties by term. Each partition keeps k rows of a group before they are shuffled."""
    best = weighted.groupBy(group, term).agg(F.max(weight).alias(weight))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), term))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
