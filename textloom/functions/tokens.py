"""Tokenising and annotating as native column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K


def unnest(df: DataFrame, keys, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array item, without rows for empty arrays.

    The outer form with a null test is used because for a plain explode Spark adds a filter on the
    array's size below it, which would compute the tokens a second time.
    """
    if pos:
        rows = df.select(*keys, F.posexplode_outer(items).alias(pos, name))
    else:
        rows = df.select(*keys, F.explode_outer(items).alias(name))
    return rows.filter(F.col(name).isNotNull())


def sentences(text: Column) -> Column:
    """Cut after a run of . ! ? that white space follows."""
    marked = F.regexp_replace(text, K.SENTENCE_END, "$1" + K.SENTENCE_MARK)
    return F.split(marked, K.SENTENCE_MARK)


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_tokens(text: Column, lower=True) -> Column:
    """Words of two or more letters, digits or underscores."""
    return find_all(F.lower(text) if lower else text, K.WORD_2PLUS)


def is_eos_punct(token: Column) -> Column:
    return token.isin(K.EOS_PUNCT)


def is_punct(token: Column) -> Column:
    return token.rlike(K.ASCII_PUNCT_ONLY)


def is_number(token: Column) -> Column:
    return token.rlike(K.FLOAT_LITERAL)


def sentence_tokens(sentence: Column) -> Column:
    """Tokens of one sentence as structs (token, piece, glued).

    A piece is what single spaces separate; a token is glued when it follows another of its piece.
    """
    pieces = F.split(sentence, " ")
    return F.flatten(
        F.transform(
            pieces,
            lambda piece, i: F.transform(
                find_all(piece, K.WORD_OR_PUNCT),
                lambda t, j: F.struct(t.alias("token"), i.alias("piece"), (j > 0).alias("glued")),
            ),
        )
    )


def _bind(value: Column, fn) -> Column:
    """fn(value) with the value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _shifted(items: Column, n: int) -> Column:
    """The items from the n-th on."""
    return F.slice(items, n, F.greatest(F.size(items) - n + 1, F.lit(0)))


def _runs(items: Column, high: int, start, join):
    """Lists for runs of length 1..high. Each length extends the one before it by the next item,
    so the cost grows with the text and not with its square."""
    runs = [start]
    for n in range(2, high + 1):
        following = _shifted(items, n)
        runs.append(F.zip_with(F.slice(runs[-1], 1, F.size(following)), following, join))
    return runs


def ngrams(tokens: Column, low: int, high: int, sep=" ") -> Column:
    """All word n-grams with low <= n <= high, in order of n then position."""
    if (low, high) == (1, 1):
        return tokens
    join = lambda a, b: F.concat(a, F.lit(sep), b)
    return _bind(tokens, lambda t: F.flatten(F.array(*_runs(t, high, t, join)[low - 1:])))


def char_ngrams(word: Column, low: int, high: int) -> Column:
    """Substrings with low <= length <= high, by length then position."""
    return ngrams(F.filter(F.split(word, ""), lambda c: c != ""), low, high, sep="")


def char_windows(text: Column, size: int) -> Column:
    """The `size` characters from every position on, fewer near the end."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return ngrams(F.concat(chars, F.array_repeat(F.lit(""), size - 1)), size, size, sep="")


def subwords(word: Column, low=3, high=6) -> Column:
    """N-grams of <word>, by length then position. Words are short, so each n-gram is cut straight
    from the word; for whole texts see `char_ngrams`."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def of_length(n):
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(marked, i, n))

    return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of_length))


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over code points, as a long (the bytes differ from code points above 127)."""
    mask = 0xFFFFFFFF
    return F.aggregate(
        F.split(word, ""),
        F.lit(K.FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(K.FNV_PRIME).cast("long"))
        .bitwiseAND(F.lit(mask).cast("long")),
    )


def word_ngram_ids(hashes: Column, n: int, buckets=K.HASH_BUCKETS) -> Column:
    """Bucket ids of the 2..n-word runs starting at each word.

    A run's hash is h * prime + next in unsigned 64-bit arithmetic, where 32-bit word hashes are
    read as signed; decimals hold the products exactly.
    """
    wrap = F.lit(str(2**64)).cast("decimal(20,0)")
    prime = F.lit(K.NGRAM_PRIME).cast("decimal(9,0)")

    def unsigned(h):
        wide = F.when(h >= 2**31, F.lit(str(2**64 - 2**32)).cast("decimal(20,0)")).otherwise(0)
        return (h.cast("decimal(10,0)") + wide).cast("decimal(20,0)")

    step = lambda h, x: F.pmod(h * prime + x, wrap).cast("decimal(20,0)")
    words = F.transform(hashes, unsigned)
    wide = _bind(words, lambda w: F.flatten(F.array(*_runs(w, n, w, step)[1:])))
    return F.transform(wide, lambda h: F.pmod(h, F.lit(buckets)).cast("long"))


def pad_left(ids: Column, width: int) -> Column:
    """Keep the last `width` ids and put zeros in front of shorter lists."""
    last = F.when(F.size(ids) > width, F.slice(ids, -width, width)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(width - F.size(ids), F.lit(0))), last)


def char_ids(text: Column, max_word: int, width: int) -> Column:
    """Character ids per word, cut or centred to max_word, then cut or zero-filled to width."""

    def ids(word):
        place = lambda c: F.instr(F.lit(K.CHAR_ALPHABET), c)
        chars = F.filter(F.split(word, ""), lambda c: c != "")
        return F.slice(
            F.transform(chars, lambda c: F.when(place(c) > 0, place(c)).otherwise(K.OTHER_CHAR_ID)),
            1, max_word)

    def centred(found):
        front = F.floor((max_word - F.size(found)) / 2).cast("int")
        zeros = lambda n: F.array_repeat(F.lit(0), n)
        return F.concat(zeros(front), found, zeros(max_word - F.size(found) - front))

    flat = F.flatten(F.transform(F.transform(F.split(text, " "), ids), centred))
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0), width)), 1, width)
