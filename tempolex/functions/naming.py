"""Which Act or country a question names: titles of Acts that are not held, other jurisdictions, and the held Act it is about."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolex.functions.analysis import words
from tempolex.functions.citations import STATUTE_NAMES, _any, read_title

# Words that place a question in another legal system.
JURISDICTIONS = ["indian", "india", "bangladesh", "bangladeshi", "english", "england", "british", "britain", "american", "america", "australian", "australia", "canadian",
                 "canada", "singaporean", "singapore", "malaysian", "malaysia", "nepalese", "nepal", "afghan", "afghanistan", "iranian", "iran"]
# Keys that are ordinary words before they are anything else, and the nouns that end the title of an Act.
NO_NAMES = ["a", "an", "the", "at", "in", "of", "on", "to", "by", "is", "it", "or", "as", "be", "no"]
ACT_NOUNS = ["Code", "Act", "Ordinance", "Constitution"]


class Names:
    """The written names of the built-in statutes and of those of a record."""

    def __init__(self, keys: tuple[str, ...] = ()):
        self.keys = {k.lower(): k for k in keys if k} | STATUTE_NAMES
        self.known = regex.compile(rf"(?<!\w)(?:{_any(self.keys)})(?!\w)", regex.I)
        self.named = regex.compile(rf"(?<![\w.])(?:{_any([k for k in self.keys if k not in NO_NAMES])})(?!\w)", regex.I)
        self.place = regex.compile(rf"(?<![\w.])({_any(JURISDICTIONS)})(?!\w)(?:\W*([\w']+))?", regex.I)

    def unheld_title(self, text: str) -> str:
        """The first capitalised title of an Act that is no held name nor part of one, '' without one."""
        held = [m.span() for m in self.known.finditer(text)]
        at = 0
        for m in regex.finditer(r"(?<!\w)(?=[A-Z(])", text):
            end = read_title(text, m.start(), ACT_NOUNS) if m.start() >= at else None
            if end is None:
                continue
            at = end
            title = " ".join(text[m.start() : end].split())
            if title.lower().removeprefix("the ") not in self.keys and not any(a <= m.start() and end <= z for a, z in held):
                return title
        return ""

    def places(self, text: str) -> list[tuple[str, str]]:
        """(word of another jurisdiction, the word behind it or '')."""
        return [(m[1].lower(), (m[2] or "").lower()) for m in self.place.finditer(text)]

    def scope(self, text: str) -> tuple[str, str]:
        """(key of the held Act with the longest name in the text, the text without that name); ('', text) without one."""
        low = " ".join(text.split()).lower()
        found = max((m.group() for m in self.named.finditer(low)), key=len, default="")
        if not found:
            return "", text
        return self.keys[found], regex.sub(rf"(?<![\w.]){regex.escape(found)}(?!\w)", " ", text, flags=regex.I)


@lru_cache(maxsize=4)
def _names(keys: tuple[str, ...]) -> Names:
    return Names(keys)


def _read(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    names = _names(keys)
    kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("word", pa.string()), ("behind", pa.string())])), pa.string(), pa.string())
    for b in batches:
        rows = [(i, names.unheld_title(t), [{"word": w, "behind": x} for w, x in names.places(t)], *names.scope(t)) for i, t in zip(b.column(0).to_pylist(), ((x or "") for x in b.column(1).to_pylist()))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item_id", "title", "places", "scope", "rest"])


def named_acts(questions: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """(item_id, unheld, scope, rest) of each question (item_id, question).

    unheld is the title or the word of a jurisdiction that the record does not answer for, '' without one; a
    jurisdiction is no such word where the record itself writes it in front of the word it qualifies. scope is the held
    Act a question names, rest the question without that name. keys are the statutes of the record, a bounded list.
    """
    read = questions.selectExpr("cast(item_id as bigint) item_id", "question").mapInArrow(
        partial(_read, keys=tuple(sorted(keys))), "item_id bigint, title string, places array<struct<word: string, behind: string>>, scope string, rest string"
    )
    written = F.explode(F.array(words(F.col("heading")), words(F.col("text"))))
    pairs = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("behind"))), lambda p: p["word"].isin(JURISDICTIONS))
    own = versions.select(written.alias("w")).select(F.explode(pairs).alias("p")).where("p.behind <> ''").select("p.word", "p.behind").distinct()
    foreign = read.select("item_id", F.posexplode("places").alias("at", "p")).select("item_id", "at", "p.word", "p.behind").join(own, ["word", "behind"], "left_anti")
    first = foreign.groupBy("item_id").agg(F.min(F.struct("at", "word")).alias("f"))
    unheld = F.when(F.col("title") != "", F.col("title")).otherwise(F.coalesce("f.word", F.lit("")))
    free = unheld == ""
    return read.join(first, "item_id", "left").select(
        "item_id", unheld.alias("unheld"), F.when(free & (F.col("scope") != ""), F.col("scope")).alias("scope"), F.when(free, F.col("rest")).alias("rest")
    )
