"""Text analysis, sentences, summaries and highlights as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Fixed value: English stop words, which match queries pass over.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing would should could ought cannot a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very"
).split()

# A sentence ends after . ! ? that follows a small letter, symbol, number or space, when punctuation, a
# space, a number or a capital comes next (anything, after a symbol) and one character more is left.
_BEFORE = r"[\p{Ll}\p{S}\p{N}\p{IsWhite_Space}]"
_AFTER = r"[\p{P}\p{IsWhite_Space}\p{N}\p{Lu}]"
SENTENCE_END = rf"(?s)(?:(?<={_BEFORE}[.!?])(?={_AFTER}.)|(?<=\p{{S}}[.!?])(?=..))"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def analysed(expression: str, stop_words: bool = False) -> list[str]:
    """The tokens of a query, as tokens() gives them for a text."""
    found = [m for m in re.findall(r"[^\W_]+", expression.lower())]
    return [t for t in found if not (stop_words and t in STOP_WORDS)]


def query_terms(terms: str) -> list[str]:
    """Terms for summaries and highlights: quotes trimmed, cut at white space."""
    return terms.strip('"').split()


def is_phrase(terms: str) -> bool:
    return len(terms) > 1 and terms.startswith('"') and terms.endswith('"')


def sentences(text: Column) -> Column:
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, SENTENCE_END, -1))


def match_ratio(sentence: Column, terms: list[str]) -> Column:
    """Share of the sentence's words that equal a term, case folded, as float."""
    words = F.filter(F.split(sentence, r"\p{IsWhite_Space}+", -1), lambda w: w != "")
    wanted = [t.lower() for t in terms] or [""]
    hits = F.size(F.filter(words, lambda w: F.lower(w).isin(*wanted)))
    return (hits.cast("float") / F.greatest(F.size(words), F.lit(1)).cast("float")).cast("float")


def match_summary(text: Column, terms: list[str], limit: int = 256) -> Column:
    """Sentences with a term, best share first until `limit` bytes are spent, in their order in the text.
    A sentence that does not fit is cut to as many characters as bytes are left; a gap shows as two dots."""
    numbered = F.transform(sentences(text), lambda s, i: F.struct((-match_ratio(s, terms)).alias("rank"), i.alias("ordinal"), s.alias("text")))
    ranked = F.array_sort(F.filter(numbered, lambda s: s["rank"] < 0))
    start = F.struct(F.lit(limit).alias("left"), F.expr("cast(array() as array<struct<ordinal:int,text:string>>)").alias("taken"))

    def take(acc: Column, s: Column) -> Column:
        cut = F.when(F.octet_length(s["text"]) > acc["left"], F.concat(F.substring(s["text"], F.lit(1), acc["left"]), F.lit("..."))).otherwise(s["text"])
        taken = F.struct((acc["left"] - F.octet_length(cut)).alias("left"), F.concat(acc["taken"], F.array(F.struct(s["ordinal"].alias("ordinal"), cut.alias("text")))).alias("taken"))
        return F.when(acc["left"] > 0, taken).otherwise(acc)

    chosen = F.array_sort(F.aggregate(ranked, start, take)["taken"])
    joined = F.aggregate(
        chosen,
        F.struct(F.lit(-1).alias("last"), F.lit("").alias("text")),
        lambda acc, s: F.struct(
            s["ordinal"].alias("last"),
            F.concat(
                acc["text"], F.when((acc["last"] != -1) & (s["ordinal"] - acc["last"] != 1), F.lit("..")).otherwise(F.lit("")),
                s["text"], F.when(s["text"].endswith("."), F.lit("")).otherwise(F.lit(".")),
            ).alias("text"),
        ),
    )
    return F.regexp_replace(joined["text"], r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def highlighted(text: Column, terms: list[str]) -> Column:
    """Every occurrence of a term, case folded and inside words too, in an em element; one term after the other."""
    for term in terms:
        pattern = "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in term)
        text = F.regexp_replace(text, f"(?iu)({pattern})", "<em>$1</em>")
    return text
