"""Text preparation as Column expressions: normalise, tokenise, drop stopwords.

Word characters are ASCII letters, digits and the underscore; everything else
separates words. The word lists and the tokeniser that inspired this behaviour
come from third-party packages whose exact content is not pinned anywhere, so
this package fixes its own definition: Spark ML's English stopword list, tokens
as maximal runs of word characters, and no lemmatisation unless a dictionary is
supplied (see ``operators/lemmas.py``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9_]+"
WORD_GAP = "[^a-z0-9_]+"

# Spark ML's default English stopwords
# (StopWordsRemover.loadDefaultStopWords("english")).
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't
didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()


def normalise(text: Column) -> Column:
    """Lower case, each run of non-word characters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, " "))


def tokenise(text: Column) -> Column:
    """Words of the normalised text, in order, straight from the raw text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def split_words(processed: Column) -> Column:
    """Words of an already processed, space-joined text."""
    return F.array_remove(F.split(processed, " "), "")


def remove_stopwords(tokens: Column, stopwords: list[str] = ENGLISH_STOPWORDS) -> Column:
    """Drop stopwords, keeping order and repeats."""
    return F.filter(tokens, lambda token: ~token.isin(stopwords))


def content_words(text: Column, stopwords: list[str] = ENGLISH_STOPWORDS) -> Column:
    """Tokenise and drop stopwords: the words that get indexed."""
    return remove_stopwords(tokenise(text), stopwords)


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units (characters beyond U+FFFF count twice)."""
    chars = F.char_length(text)
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.when(F.octet_length(text) == chars, chars).otherwise(units).cast("bigint")
