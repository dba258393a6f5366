"""Licence scans with a positional index of rare words.

A template is a run of words with a label and mandatory key phrases inside it: whole texts and
notices of public licences, and the base phrases, whose key phrase is the whole phrase.  Document
frequencies of all words of key phrases are counted over the whole corpus (one row per word comes
back).  The index has postings for the ``RARE`` words of highest inverse document frequency of each
template's key phrases: word, template, offset.

A file's places of these words are looked up in the index, all templates at once: each place less
a posting's offset is where the template would start.  Postings are intersected by that relative
position, by sorting: a start that all of a template's rare words agree on is a candidate, and it
stands if every word of the key phrases stands at its place.  As each of them must, no place is
missed, whatever the frequencies.  The score is the largest share of a template's words that stand
where they should.

Everything is a map over the words of a text, by DataFrame functions only; the one shuffle is
that of the frequency counts.  The cost of a file grows with its places of rare words, not with
the number of templates.

Defined results: a null or empty text has no words, no places (first and last null), empty
labels and score 0; repeated rows get equal results; texts are read whole; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import license_texts
from tesserae.llm.common import text_or_empty

#: What stands between words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters outside ASCII whose lower case holds ASCII (Kelvin sign, I with dot), and what stands in for them.
SET_ASIDE = (("\u212a", "\ue000"), ("\u0130", "\ue001"))


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...] = field(default=())
    base: bool = False

    def mandatory(self) -> list[tuple[int, str]]:
        """(offset, word) of the mandatory phrases, each at its first place in the template."""
        found: dict[int, str] = {}
        for p in self.phrases or (self.words,):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)
            found |= {at + j: w for j, w in enumerate(p)}
        return sorted(found.items())


def template(name: str, label: str, text: str, *phrases: str, base: bool = False) -> Template:
    return Template(name, label, tuple(text.split()), tuple(tuple(p.split()) for p in phrases), base)


#: The base phrases and their labels.
BASE = (
    template("base-mit", "mit", "under the mit license", base=True),
    template("base-apache", "apache-2", "apache license version 2", base=True),
    template("base-cc", "cc-by-nc", "cc by nc", base=True),
)
#: Rare words of its key phrases that a template is looked up under.
RARE = 3


def words_of(text: str) -> str:
    """A template's text as words, in the way of ``word_array``."""
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


def public_templates() -> tuple[Template, ...]:
    """Texts of public licences, and notices put together from their names."""
    out = [template(name, label, words_of(text), *phrases) for name, label, text, phrases in license_texts.TEXTS]
    for label, name in license_texts.NAMES:
        out += [template(f"{verb}-{label}-{name.replace(' ', '-')}", label, f"{verb} under the {name}", f"under the {name}") for verb in license_texts.VERBS]
    for label, letters in license_texts.LETTERS:
        out += [template(f"{verb}-{label}", label, f"{verb} under cc {letters}", f"cc {letters}") for verb in license_texts.VERBS]
    out += [template(f"spdx-{name.replace(' ', '-')}", label, f"spdx license identifier {name}", f"license identifier {name}") for label, name in license_texts.IDENTIFIERS]
    return tuple(out)


MORE = public_templates()


def word_array(text: str) -> Column:
    """Words of a text, with an empty string in front or behind where a separator stands there.

    Two letters whose lower case is ASCII are set aside first, so that lower() acts on A-Z as
    far as ASCII words go."""
    kept = text_or_empty(text)
    for letter, stand_in in SET_ASIDE:
        kept = F.replace(kept, F.lit(letter), F.lit(stand_in))
    return F.split(F.lower(kept), SEPARATORS)


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary; a row per word comes to the driver."""
    hit = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in hit.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_words(t: Template, df: dict[str, int]) -> list[tuple[int, str]]:
    """(offset, word) of the rarest words of a template's key phrases."""
    return sorted(t.mandatory(), key=lambda x: (df[x[1]], x[1], x[0]))[:RARE]


def constant(value: object, kind: str) -> Column:
    """A table of the index as one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def found_places(rows: DataFrame, every: list[Template], rare: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """``rows`` with ``found``: array of struct(t, s) of the templates (by number) that stand in
    ``words``, each with its start."""
    postings: dict[str, list[dict[str, int]]] = {}
    for number, t in enumerate(every):
        for offset, word in rare[t.name]:
            postings.setdefault(word, []).append({"t": number, "o": offset})
    index = constant(postings, "map<string,array<struct<t:int,o:int>>>")
    need = constant([len(rare[t.name]) for t in every], "array<int>")
    key_words = constant([[{"o": o, "w": w} for o, w in t.mandatory()] for t in every], "array<array<struct<o:int,w:string>>>")

    def word(i: Column) -> Column:
        return F.get("words", i)

    def places(n: Column) -> Column:
        """0 to n - 1."""
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def starts(i: Column) -> Column:
        return F.transform(F.element_at(index, word(i)), lambda p: F.struct(p["t"].alias("t"), (i - p["o"]).alias("s")))

    def agreed(i: Column) -> Column:
        """Whether the first of equal starts stands here, and as many as the template has rare words."""
        own = F.get("starts", i)
        first = F.coalesce(F.get("starts", i - 1) != own, F.lit(True))
        return first & F.coalesce(F.get("starts", i + F.element_at(need, own["t"] + 1) - 1) == own, F.lit(False))

    def stands(c: Column) -> Column:
        return F.coalesce(F.forall(F.element_at(key_words, c["t"] + 1), lambda k: F.coalesce(word(c["s"] + k["o"]) == k["w"], F.lit(False))), F.lit(False))

    looked_up = rows.withColumn("hits", F.filter(places(F.size("words")), lambda i: word(i).isin(sorted(postings))))
    met = looked_up.withColumn("starts", F.array_sort(F.flatten(F.transform("hits", starts)))).drop("hits")
    candidates = met.withColumn("candidates", F.transform(F.filter(places(F.size("starts")), agreed), lambda i: F.get("starts", i))).drop("starts")
    return candidates.withColumn("found", F.filter("candidates", stands)).drop("candidates")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    every = [*base, *more]
    rows = docs.select(F.col(key).alias("doc_id"), word_array(text).alias("words"))
    df = document_frequencies(rows, sorted({w for t in every for _, w in t.mandatory()}))
    rare = {t.name: rare_words(t, df) for t in every}
    words = F.col("words")
    lead = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    counted = rows.select("doc_id", "words", lead.alias("lead"), F.greatest(F.lit(0), F.size(words) - lead - tail).cast("long").alias("n_words"))
    texts, names = constant([list(t.words) for t in every], "array<array<string>>"), constant([t.label for t in every], "array<string>")

    def cover(c: Column) -> Column:
        own = F.element_at(texts, c["t"] + 1)
        return F.size(F.filter(F.transform(own, lambda w, j: F.coalesce(F.get(words, c["s"] + j) == w, F.lit(False))), lambda x: x)) / F.size(own)

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda c: F.element_at(names, c["t"] + 1)))), ",")

    found = found_places(counted, every, rare)
    own = F.filter("found", lambda c: c["t"] < len(base))
    starts = F.transform(own, lambda c: c["s"] - F.col("lead"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(own).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.round(F.array_max(F.transform("found", cover)), 6), F.lit(0.0)).alias("score"),
    )


def duckdb_sql(base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE) -> str:
    """The same scan in DuckDB's SQL, over unnested words."""
    every = [*base, *more]
    rows = ",\n".join(f"('{t.name}','{t.label}',{int(t.base)},{len(t.words)},{j},'{w}')" for t in every for j, w in enumerate(t.words))
    mand = ",".join(f"('{t.name}',{o},'{w}')" for t in every for o, w in t.mandatory())
    body = "coalesce(text, '')"
    for letter, stand_in in SET_ASIDE:
        body = f"replace({body}, '{letter}', '{stand_in}')"
    return rf"""
WITH tw(t, label, base, len, off, word) AS (VALUES {rows}),
mand(t, off, word) AS (VALUES {mand}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({body}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
df AS (SELECT v.word, (SELECT count(DISTINCT doc_id) FROM w WHERE w.word = v.word) AS n FROM (SELECT DISTINCT word FROM mand) v),
ranked AS (SELECT t, off, word, row_number() OVER (PARTITION BY t ORDER BY n, word, off) AS r FROM mand JOIN df USING (word)),
rare AS (SELECT * FROM ranked WHERE r <= {RARE}),
need AS (SELECT t, count(*) AS need FROM rare GROUP BY t),
cand AS (SELECT doc_id, t, i - off AS s, count(*) AS votes FROM w JOIN rare USING (word) GROUP BY doc_id, t, i - off),
ok AS (SELECT c.doc_id, c.t, c.s FROM cand c JOIN need USING (t) JOIN mand m ON m.t = c.t JOIN w ON w.doc_id = c.doc_id AND w.i = c.s + m.off AND w.word = m.word
       WHERE votes = need GROUP BY c.doc_id, c.t, c.s HAVING count(*) = (SELECT count(*) FROM mand m2 WHERE m2.t = c.t)),
cover AS (SELECT o.doc_id, o.t, o.s, any_value(tw.label) AS label, any_value(tw.base) AS base, count(*) / any_value(tw.len)::DOUBLE AS cover
          FROM ok o JOIN tw ON tw.t = o.t JOIN w ON w.doc_id = o.doc_id AND w.i = o.s + tw.off AND w.word = tw.word GROUP BY o.doc_id, o.t, o.s),
agg AS (SELECT doc_id, count(*) FILTER (base = 1) AS n_base, min(s) FILTER (base = 1) AS first_word, max(s) FILTER (base = 1) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM cover GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(score, 6), 0.0) AS score
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id
"""
