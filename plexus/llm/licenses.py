"""License scan by a positional rare-token index, in DataFrame operations alone.

Templates are word sequences with mandatory key phrases.  The document frequency of every template
word is counted over the whole corpus; a template is posted in the index under the rarest words of
its key phrases with their offsets.  A file looks up its rarest licence words, each posting turns a
word's place into a start of the template, and the starts that all of a template's posted words
agree on are intersected.  What remains is verified: every key phrase must stand at its place and
enough of the template's other words at theirs.  All of it happens inside a document's row, so
nothing is shuffled but the word counts, one row per template word.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds after A-Z are lower-cased.  Null and
empty texts have no words, no labels, score 0 and null places.  Overlapping places all count.
Rows are judged one by one, so repeated rows and extra columns change nothing; ``scan`` replaces
columns called ``__words`` or ``__matches``.  The work in a row is linear in its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices, the label each gives and the key phrases that it must hold.
NOTICES = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted", "obtaining a copy"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Rarest key-phrase words that a template is posted under.
POSTED = 3
#: Least share of a template's words that must stand at their places.
COVER = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``keys`` are (offset, words) of the mandatory phrases."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def _template(label: str, text: str, keys: list[str], base: bool) -> Template:
    words, found = tuple(text.split()), []
    for key in keys:
        k = tuple(key.split())
        found.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
    return Template(label, words, tuple(found), base)


def templates() -> list[Template]:
    return [_template(v, k, [k], True) for k, v in BASE.items()] + [_template(*n, False) for n in NOTICES]


def word_array(text: Column) -> Column:
    """The words of a text; the empty array for a null."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of the given words over all texts."""
    held = F.array_intersect(word_array(F.col(text_col)), _literal(vocabulary))
    rows = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def _posted(t: Template, weight: dict[str, float]) -> list[tuple[str, int]]:
    """The template's rarest key-phrase words with their offsets, rarest first."""
    places = {w: at + i for at, k in reversed(t.keys) for i, w in reversed(list(enumerate(k)))}
    return sorted(places.items(), key=lambda p: (-weight[p[0]], p[1]))[:POSTED]


def _starts(word: str, at: int) -> Column:
    """Starts that a posting of a word tells, by the word's places."""
    return F.transform(F.filter("__hits", lambda h: h["w"] == word), lambda h: h["i"] - at)


def _matches(t: Template, postings: list[tuple[str, int]]) -> Column:
    """Matches of one template from the row's ``__array`` and ``__hits``."""
    starts = reduce(F.array_intersect, [_starts(w, at) for w, at in postings])

    def verified(s: Column) -> Column:
        """Key phrases at their places; a notice's words before the first one may be cut off."""
        ok = F.lit(True)
        for at, k in t.keys:
            ok = F.when(ok & (s + at >= 0), F.slice("__array", F.greatest(s + at, F.lit(0)) + 1, len(k)) == _literal(k)).otherwise(False)
        return ok

    def told(s: Column) -> Column:
        same = F.filter(_literal(t.words), lambda w, i: F.get(F.col("__array"), s + i).eqNullSafe(w))
        return F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("start"), F.lit(len(t.words)).alias("n_words"),
                        (F.size(same) / len(t.words)).alias("cover"), F.lit(t.base).alias("base"))

    found = F.transform(F.filter(starts, verified), told)
    return F.filter(found, lambda m: m["cover"] >= COVER)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__words`` (their number) and ``__matches``, an array of
    ``(label, start, n_words, cover, base)`` with one entry for every place of every template."""
    every = templates()
    weight = idf(docs, sorted({w for t in every for w in t.words}), text_col)
    index = {t: _posted(t, weight) for t in every}
    rarest = sorted({p[0][0] for p in index.values()})
    posted = sorted({w for p in index.values() for w, _ in p})
    kept = [_named(c) for c in docs.columns if c not in ("__words", "__matches")]
    # the columns travel as one, so that none of them can clash with those made here
    rows = docs.select(F.struct(*kept).alias("__row"), word_array(_named(text_col)).alias("__array"))
    hits = F.filter(F.transform("__array", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(posted))
    rows = rows.withColumn("__hits", F.when(F.arrays_overlap("__array", _literal(rarest)), hits))
    found = F.flatten(F.array(*[_matches(t, p) for t, p in index.items()]))
    return rows.select("__row.*", F.size("__array").cast("long").alias("__words"),
                       F.when(F.col("__hits").isNotNull(), found).alias("__matches"))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word count, base places, labels and the best template's cover as score."""
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    none = F.expr("cast(array() as array<struct<label:string,start:bigint,n_words:int,cover:double,base:boolean>>)")
    rows = rows.select("doc_id", F.col("__words").alias("n_words"), F.coalesce("__matches", none).alias("m"))
    base = F.filter("m", lambda x: x["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("m")).alias("labels"),
        F.coalesce(F.array_max(F.transform("m", lambda x: x["cover"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same columns in DuckDB SQL, by plain phrase search."""
    each = []
    for t in templates():
        at, k = t.keys[0]
        tests = [f"list_extract(w, i + {o + j - at + 1}) = '{x}' and i + {o - at} >= 0" for o, key in t.keys for j, x in enumerate(key)]
        cover = " + ".join(f"(case when i + {j - at} >= 0 and list_extract(w, i + {j - at + 1}) = '{x}' then 1 else 0 end)" for j, x in enumerate(t.words))
        each.append(f"select doc_id, '{t.label}' as label, i - {at} as start, ({cover}) / {len(t.words)}.0 as cover, {str(t.base).lower()} as base from places where {' and '.join(tests)}")
    found = " union all ".join(each)
    return f"""
    with rows as (select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    places as (select r as doc_id, w, unnest(range(len(w))) as i from rows),
    found as (select * from ({found}) where cover >= {COVER}),
    per as (select doc_id as r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
        string_agg(distinct label, ',' order by label) as labels, max(cover) as score from found group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
        coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from rows left join per using (r)
    """
