"""Words, stop words and answer normal forms."""

from pyspark.sql import Column, functions as F

# A word is a maximal run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
GAP = r"[^\p{L}\p{N}_]+"

# A token is a word or a mark; pieces are tokens with the blanks before them (and the
# blanks at the end), so that they spell the whole text. They stand in for model tokens wherever
# tokens are counted or cut.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
PIECE = r"[\s\p{Z}]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}])|[\s\p{Z}]+"

# The common English stop-word list.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION_BUT_COMMA_AND_PERIOD = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The ``words`` of a text as one string, a blank between two; one may be at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(GAP), F.lit(" "))


def content_words(column: str, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Words of a column without stop words, which are compared as written, before any stemming."""
    if not stop_words:
        return words(F.col(column))
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop_words)
    return F.expr(
        f"filter(regexp_extract_all(coalesce(`{column}`, ''), r'{WORD}', 0), w -> w not in ({listed}))"
    )


def token_count(text: Column) -> Column:
    """Default token count; callers with a model tokenizer pass their own function instead."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("bigint")


def first_tokens(text: Column, limit) -> Column:
    """The longest beginning of ``text`` with at most ``limit`` tokens; a negative limit gives ''."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    kept = F.slice(pieces, F.lit(1), F.greatest(limit, F.lit(0)).cast("int"))
    return F.when(token_count(text) <= limit, text).otherwise(F.array_join(kept, ""))


def answer_form(text: Column) -> Column:
    """Lower case, no punctuation, no English articles, single blanks."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(no_articles, r"(?U)\s+", " "))


def relaxed_form(text: Column) -> Column:
    """Drop punctuation except commas and periods, ignore case."""
    return F.lower(
        F.translate(F.coalesce(text, F.lit("")), PUNCTUATION_BUT_COMMA_AND_PERIOD, "")
    )


def unquote_answers(answers: Column) -> Column:
    """Answers written as '...' become "..."."""
    return F.transform(answers, lambda a: F.regexp_replace(a, r"^'(.*)'$", '"$1"'))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_starts(ordered: Column) -> Column:
    """Positions in a sorted list where a new value begins."""
    return F.when(
        F.size(ordered) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        ),
    ).otherwise(F.array().cast("array<int>"))


def run_length(ordered: Column, starts: Column, begin: Column, index: Column) -> Column:
    return F.coalesce(F.get(starts, index + 1), F.size(ordered)) - begin


def numbered(tokens: Column) -> Column:
    """Tokens made distinct by their occurrence number, so that list intersection counts repeats."""

    def number(ordered, starts):
        return F.flatten(
            F.transform(
                starts,
                lambda begin, i: F.transform(
                    F.sequence(F.lit(1), run_length(ordered, starts, begin, i)),
                    lambda n: F.concat_ws(" ", F.get(ordered, begin), n.cast("string")),
                ),
            )
        )

    return let(
        F.sort_array(tokens), lambda ordered: let(run_starts(ordered), lambda s: number(ordered, s))
    )
