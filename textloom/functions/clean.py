"""Text cleaning as native column expressions (no Python runs per row)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import constants as K


def _rewrite(text: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated pieces, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def lower_split(text: Column) -> Column:
    """Lower-case, cut at single spaces, strip each piece; empty pieces stay."""
    return F.transform(F.split(F.lower(text), " "), strip)


def remove_special_characters(text: Column) -> Column:
    """Delete ASCII punctuation inside each word and drop words left empty."""
    bare = F.transform(words(text), lambda t: F.regexp_replace(t, K.ASCII_PUNCT, ""))
    return F.array_join(F.filter(bare, lambda t: t != ""), " ")


def is_stopword(token: Column, lang: Column | None = None, stopwords=None) -> Column:
    """Exact match against one list, or against the list of the row's language."""
    if lang is None:
        return token.isin(list(stopwords or K.STOPWORDS["en"]))
    test = F.lit(False)
    for code, listed in (stopwords or K.STOPWORDS).items():
        test = F.when(lang == code, token.isin(list(listed))).otherwise(test)
    return test


def remove_stopwords(text: Column, lang: Column | None = None, stopwords=None) -> Column:
    kept = F.filter(words(text), lambda t: ~is_stopword(t, lang, stopwords))
    return F.array_join(kept, " ")


def expand_contractions(text: Column) -> Column:
    """Expand listed contractions, longest first, keeping the first letter's case; then drop "'".

    One that begins with the apostrophe has no first letter to keep and is replaced whole.
    """
    table = literal_map(K.CONTRACTIONS.items())
    found = F.regexp_extract_all(text, F.lit(K.CONTRACTION_PATTERN), F.lit(0))
    between = F.split(text, K.CONTRACTION_PATTERN)

    def expand(match):
        full = table[F.lower(match)]
        first = F.substring(match, 1, 1)
        return F.when(first == "'", full).otherwise(F.concat(first, F.substr(full, F.lit(2))))

    pieces = F.zip_with(
        between, found, lambda gap, m: F.concat(gap, F.coalesce(expand(m), F.lit("")))
    )
    whole = F.when(F.contains(text, F.lit("'")), F.array_join(pieces, "")).otherwise(text)
    return F.replace(whole, F.lit("'"), F.lit(""))


def normalize(text: Column, lang: Column | None = None) -> Column:
    """Contractions, then special characters, then stop words."""
    return remove_stopwords(remove_special_characters(expand_contractions(text)), lang)


def unescape(text: Column, entities=None) -> Column:
    return reduce(
        lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities or K.ENTITIES, text
    )


def strip_tags(html: Column, inside=r"<[^<]+?>") -> Column:
    return F.regexp_replace(html, inside, "")


def html_words(html: Column) -> Column:
    """Letters-only lower-case words of a page."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    plain = unescape(F.regexp_replace(bare, r"<[^>]*>", ""))
    return words(F.lower(F.regexp_replace(plain, r"[^a-zA-Z]", " ")))


def visible_text(html: Column) -> Column:
    """Drop script and style elements, then every tag; one line, single spaces."""
    dropped = _rewrite(
        html,
        [
            (r"(?is)<script[^>]*>.*?</script>", " "),
            (r"(?is)<style[^>]*>.*?</style>", " "),
            (r"(?s)<!--.*?-->", " "),
            (r"<[^>]*>", " "),
        ],
    )
    return squeeze(unescape(dropped))


def clean_question(text: Column) -> Column:
    """Ordered question rewrites on lower-cased, single-spaced text."""
    return _rewrite(F.array_join(words(F.lower(text)), " "), K.QUESTION_REWRITES)


def clean_sentence(text: Column) -> Column:
    return _rewrite(
        F.lower(text),
        [
            (r"['\"-]", ""),
            (rf"([^{K.WORD_CHARS}]+)", r" $1 "),
            (r"\s\S\s", " "),
            (r"\s+", " "),
        ],
    )


def split_on_stops(text: Column) -> Column:
    """Cut at full stops after "!" and "?" are made to end a sentence too."""
    marked = F.regexp_replace(text, r"([!?])", r" $1 .")
    return F.split(F.regexp_replace(marked, r"[().*\n]+\z", ""), r"\.")


def clean_social(text: Column) -> Column:
    """Drop mentions, links and hash tags as whole words."""
    return F.array_join(F.filter(words(text), lambda t: ~t.rlike(r"^(\.?@|http|#)")), " ")


def rule_tokens(text: Column) -> Column:
    """Rule tokeniser: marks removed, commas kept only inside numbers, clitics detached."""
    chain = [
        (r"[)(?:/.;!\[\]\"=]", ""),
        (r"(^|\s),+|,+(\s|\z)", "$1$2"),
        (r"([^0-9\s]),+", "$1 "),
        (r",+([^0-9\s])", " $1"),
        (r"i'm", "i am"),
        (r"'ve", " have"),
        (r"n't", " not"),
        (r"'ll", " will"),
        (r"'s(\s|\z)", " 's$1"),
        (r"s'(\s|\z)", "s 's$1"),
        (r"-", " "),
    ]
    return words(_rewrite(F.lower(text), chain))


def isolate_punctuation(text: Column) -> Column:
    return _rewrite(F.lower(text), K.LINE_REWRITES)


def strip_wiki(text: Column) -> Column:
    """Visible wiki text in a-z and single spaces, digits spelt."""
    bare = F.lower(_rewrite(text, K.WIKI_REWRITES))
    spelt = _rewrite(bare, [(str(i), f" {w} ") for i, w in enumerate(K.DIGIT_WORDS)])
    return F.trim(F.regexp_replace(spelt, r"[^a-z]+", " "))


def remove_bracketed(text: Column) -> Column:
    """Drop text inside (), [] and {}; stray closers stay, an open bracket drops the rest.

    The fold runs over bracket-free stretches, so its cost follows the number of brackets.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^()\[\]{}]+|[()\[\]{}]"), F.lit(0))
    openers, closers = "([{", ")]}"
    start = F.struct(
        *[F.lit(0).alias(f"d{i}") for i in range(3)],
        F.array().cast("array<string>").alias("kept"),
    )

    def step(state, piece):
        depths, stray = [], F.lit(False)
        for i in range(3):
            depth = state[f"d{i}"]
            stray = stray | ((piece == closers[i]) & (depth == 0))
            depths.append(
                F.when(piece == openers[i], depth + 1)
                .when((piece == closers[i]) & (depth > 0), depth - 1)
                .otherwise(depth)
            )
        is_bracket = piece.isin(list(openers + closers)) & ~stray
        outside = (depths[0] + depths[1] + depths[2]) == 0
        kept = F.when(
            outside & ~is_bracket, F.concat(state["kept"], F.array(piece))
        ).otherwise(state["kept"])
        return F.struct(*[d.alias(f"d{i}") for i, d in enumerate(depths)], kept.alias("kept"))

    folded = F.aggregate(pieces, start, step, lambda s: F.array_join(s["kept"], ""))
    return F.when(text.rlike(r"[()\[\]{}]"), folded).otherwise(text)


def replace_inline_tags(text: Column, tags=None, use_word=True) -> Column:
    """Replace <TAG>..</TAG> by the tag's word or by its content; an unclosed tag is an error."""
    for tag, word in (tags or K.INLINE_TAGS).items():
        text = F.regexp_replace(text, rf"(?s)<{tag}>(.*?)</{tag}>", word if use_word else "$1")
        text = F.when(
            F.contains(text, F.lit(f"<{tag}>")),
            F.raise_error(F.lit(f"tag {tag} is not closed")).cast("string"),
        ).otherwise(text)
    return text


def skip_first_line(text: Column) -> Column:
    """Drop the first line and blank lines, right-strip the others, join with one space."""
    lines = F.split(text, "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    trimmed = F.transform(rest, lambda x: F.regexp_replace(x, r"\s+\z", ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), " ")


def mail_body(text: Column) -> Column:
    """Lines after the first blank line; empty when there is none."""
    parts = F.split(text, "\n\n", 2)
    return F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
