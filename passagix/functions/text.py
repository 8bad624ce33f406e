"""Tokens as column expressions. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore of any script: what a word character is to a Unicode-aware \\w.
WORD = "[\\p{L}\\p{N}_]+"
GAP = "[^\\p{L}\\p{N}_]+"

#: English stopwords, without those that hold an apostrophe, which no token can equal.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def chunk_tokens(text: str | Column) -> Column:
    """Lower-case words of a text, numbers among them. Null: none."""
    # What stands between words splits the text; only before the first and after the last is the piece empty.
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), GAP), "")


def tokens(text: str | Column) -> Column:
    """chunk_tokens without stopwords: the tokens of documents and queries. The list becomes a hash set in the plan."""
    return F.filter(chunk_tokens(text), lambda w: ~w.isin(*STOPWORDS))


def model_slug(name: str | Column) -> Column:
    """A model's name as part of a file name."""
    return F.lower(F.translate(name, "/-", "__"))


def encoder_text(text: str | Column, model: str, query: bool) -> Column:
    """What an encoder is given: models named e5 want to know queries from passages."""
    column = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("query: " if query else "passage: "), column) if "e5" in model.lower() else column
