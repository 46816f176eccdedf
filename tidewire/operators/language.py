"""Sentences, words and names of texts. Language models aren't at hand; an extractor is any function of a text that gives its words with tag and kind of name, and the one here goes by rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.stemmer import stem

WORDS = "array<struct<raw:string,lemma:string,tag:string,ner:string>>"
Extractor = Callable[[str], list[dict]]

_TOKEN = re.compile(r"[$€£¥]\s?\d[\d,.]*|\d{1,2}:\d{2}|\d[\d,.]*\d|\d|\w+(?:['’]\w+)?|[^\w\s]")
_END = re.compile(r"(?<=[.!?])(?<!Mr\.)(?<!Ms\.)(?<!Mrs\.)(?<!Dr\.)(?<!Prof\.)[\"'”’)]*\s+")
_TITLES = {"Mr", "Ms", "Mrs", "Dr", "Prof", "Captain", "Judge"}
_ORGANISATION = {"Company", "Council", "Bureau", "Museum", "College", "Union", "Trust", "Society", "Institute", "Works", "University"}
_DAYS = {"Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"}


#: English words of closed classes with their tags.
_CLOSED = {
    "DT": "a an the this that these those each every some any no all both another",
    "IN": "of in on at by for with from about into over after before between under during without within against through because while if since until although though than as like near across behind beyond",
    "PRP": "i you he she it we they me him us them himself herself itself themselves",
    "PRP$": "my your his her its our their",
    "CC": "and or but nor yet",
    "MD": "can could may might must shall should will would",
    "WDT": "which whatever",
    "WP": "who whom what",
    "WRB": "when where why how",
    "TO": "to",
    "EX": "there",
    "RB": "not never also very too then now here again still already often only just once",
    "VB": "be",
    "VBD": "was were had did said",
    "VBG": "being having",
    "VBN": "been",
    "VBP": "am are have do",
    "VBZ": "is has does",
}
#: Endings and the tags they speak for, the longest first.
_ENDINGS = (("able", "JJ"), ("ible", "JJ"), ("less", "JJ"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("ish", "JJ"), ("ing", "VBG"), ("est", "JJS"), ("ary", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("ly", "RB"), ("ed", "VBD"))
_TAGS = {w: tag for tag, listed in _CLOSED.items() for w in listed.split()}
_HAVE, _BE = {"have", "has", "had", "having"}, {"be", "am", "is", "are", "was", "were", "been", "being"}
_NOUNS = ("NN", "NNS", "NNP")


def tags_of(raw: list[str], kinds: list[str]) -> list[str]:
    """Tags of a sentence's words in the usual set: closed classes by their words, names NNP, numbers CD, signs themselves; else by the ending, and last by the words before and after."""
    out = []
    for w, kind in zip(raw, kinds, strict=True):
        low = w.lower()
        if any(c.isdigit() for c in w) and not w[0].isalpha():
            tag = "CD"
        elif not w[0].isalnum():
            tag = w
        elif kind in ("PERSON", "ORGANIZATION", "LOCATION"):
            tag = "NNP"
        elif low in _TAGS:
            tag = _TAGS[low]
        elif w in _DAYS:
            tag = "NNP"
        else:
            tag = next((t for end, t in _ENDINGS if low.endswith(end) and len(low) > len(end) + 2), None) or ("NNS" if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else "NN")
        out.append(tag)
    for i, tag in enumerate(out):
        before, after = out[i - 1] if i else "", out[i + 1] if i + 1 < len(out) else ""
        back = [w.lower() for w in raw[max(0, i - 3) : i]]
        if tag in ("NN", "NNS") and before in ("TO", "MD"):
            out[i] = "VB"
        elif tag == "NN" and before == "PRP" and after in ("TO", "DT", "IN", "PRP", "PRP$"):
            out[i] = "VBP"
        elif tag == "NNS" and before in ("PRP", "NNP", "NN", "WP", "WDT") and after in ("DT", "IN", "PRP$", "TO", "CD", "RB", "NNP"):
            out[i] = "VBZ"
        elif tag == "VBD" and raw[i].lower() not in _TAGS and any(w in _HAVE | _BE for w in back) and all(w in _HAVE | _BE or _TAGS.get(w) == "RB" for w in back[next(k for k, w in enumerate(back) if w in _HAVE | _BE) :]):
            out[i] = "VBN"
        elif tag in ("VBG", "VBD") and before in ("DT", "PRP$", "JJ"):
            out[i] = "NN" if after not in _NOUNS else "VBN" if tag == "VBD" else "VBG"
        elif tag == "JJ" and before in ("DT", "PRP$") and after not in (*_NOUNS, "JJ", "VBG", "VBN"):
            out[i] = "NN"
    return out


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text."""
    return [s.strip() for s in _END.split(text or "") if s.strip()]


def by_rules(text: str | None) -> list[dict]:
    """Words of a text with stems, tags (``tags_of``) and names of kind PERSON, ORGANIZATION, LOCATION, MONEY, TIME, or O. Capital letters make names, but for days and, at a sentence's start, words of closed classes."""
    out = []
    for sentence in split_sentences(text):
        raw = _TOKEN.findall(sentence)
        kinds = ["O"] * len(raw)
        i = 0
        while i < len(raw):
            j = i
            while j < len(raw) and raw[j][0].isupper() and raw[j] not in _DAYS and not (raw[j].lower() in _TAGS and (j == 0 or len(raw[j]) == 1)) and (j > 0 or j + 1 < len(raw) and raw[j + 1][:1].isupper() or raw[j] in _TITLES):
                j += 1 + (j + 1 < len(raw) and raw[j] in _TITLES and raw[j + 1] == ".")
            if j > i:
                run = raw[i:j]
                kind = "ORGANIZATION" if run[-1] in _ORGANISATION else "PERSON" if run[0] in _TITLES or (i and raw[i - 1] == "said") else "LOCATION" if i and raw[i - 1] in ("in", "In", "at", "near", "from", "for") else "PERSON"
                kinds[i:j] = [kind] * (j - i)
                i = j
            else:
                kinds[i] = "MONEY" if raw[i][0] in "$€£¥" else "TIME" if raw[i] in _DAYS or re.fullmatch(r"\d{1,2}:\d{2}", raw[i]) else "O"
                i += 1
        for w, kind, tag in zip(raw, kinds, tags_of(raw, kinds), strict=True):
            out.append({"raw": w, "lemma": stem(w.lower()), "tag": tag, "ner": kind})
    return out


def extracted(texts: DataFrame, key: str, text: str, extractor: Extractor = by_rules) -> DataFrame:
    """(key, words): the extractor's words of each text; null texts have none. In Arrow batches."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "words": [extractor(t) for t in frame[text]]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, words {WORDS}")


def word_rows(words: DataFrame, key: str) -> DataFrame:
    """(key, place, raw, lemma, tag, ner), a row for each word."""
    return words.select(key, F.posexplode("words").alias("place", "w")).select(key, "place", "w.*")


def nouns(rows: DataFrame) -> DataFrame:
    """Words tagged as nouns."""
    return rows.where(F.col("tag").isin("NN", "NNS", "NNP", "NNPS"))


def merged_names(rows: DataFrame, key: str, place: str = "place", raw: str = "raw", kind: str = "ner") -> DataFrame:
    """(key, start, name, kind): runs of neighbouring words of the same kind of name, joined by spaces. Words of kind O and null are none's. Windows are by document."""
    w = Window.partitionBy(key).orderBy(place)
    new = F.coalesce((F.lag(kind).over(w) != F.col(kind)) | (F.lag(place).over(w) != F.col(place) - 1), F.lit(True))
    runs = rows.where(F.coalesce(F.col(kind), F.lit("O")) != "O").withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    grouped = runs.groupBy(key, "_run").agg(F.min(place).alias("start"), F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(raw).alias("r")))).alias("_w"), F.first(kind).alias("kind"))
    return grouped.select(key, "start", F.array_join(F.transform("_w", lambda x: x["r"]), " ").alias("name"), "kind")


def name_counts(names: DataFrame) -> DataFrame:
    """(kind, name, n)."""
    return names.groupBy("kind", "name").agg(F.count("*").alias("n"))


def names_by_kind(names: DataFrame, key: str) -> DataFrame:
    """(key, kind, names): sorted distinct names of each document and kind."""
    return names.groupBy(key, "kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def zipped(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with ``words``: parallel arrays as one array of structs."""
    return rows.withColumn("words", F.arrays_zip(*columns))
