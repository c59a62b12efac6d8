"""Word lists, character tables and patterns that decide results."""

# Patterns. They are written so that Java regex and RE2 read them alike.
WORD_CHARS = r"\p{L}\p{N}_"
WORD_2PLUS = r"[\p{L}\p{N}_]{2,}"
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
LETTERS_APOSTROPHE = r"['a-zA-Z]+"
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
ASCII_PUNCT_ONLY = r"^[!-/:-@\[-`{-~]+\z"
FLOAT_LITERAL = (
    r"(?i)^[+-]?((\d+(_\d+)*)(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\z"
)
SENTENCE_END = r"([.!?]+)[ \t\r\n]+"
SENTENCE_MARK = "\x01"

# Punctuation tokens that can close a sentence.
EOS_PUNCT = ["!", '"', "'", ".", ":", "?"]

# Markup entities decoded to text; "&amp;" is decoded last.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

# Fixed stop-word lists, one per language of the corpus.
STOPWORDS = {
    "en": """i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now""".split(),
    "fr": """au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me
même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton
tu un une vos votre vous est sont était être avoir a ont""".split(),
    "de": """aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem
den der des die dies dir doch du ein eine einem einen einer eines er es für hat hatte ich ihr im in
ist ja kein mein mich mir mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so über
um und uns von vor war was wie wir zu zum zur""".split(),
    "es": """al algo como con de del desde donde el ella ellos en entre era es esta este fue ha
hasta hay la las le les lo los más me mi muy no nos o para pero por porque que quién se ser si sin
sobre su sus te tu un una uno y ya""".split(),
}

# Fixed contraction list: "form=expansion", matched without case, longer forms first.
_CONTRACTIONS = """
ain't=is not
aren't=are not
can't=cannot
can't've=cannot have
'cause=because
could've=could have
couldn't=could not
couldn't've=could not have
didn't=did not
doesn't=does not
don't=do not
hadn't=had not
hadn't've=had not have
hasn't=has not
haven't=have not
he'd=he would
he'd've=he would have
he'll=he will
he'll've=he will have
he's=he is
how'd=how did
how'd'y=how do you
how'll=how will
how's=how is
i'd=i would
i'd've=i would have
i'll=i will
i'll've=i will have
i'm=i am
i've=i have
isn't=is not
it'd=it would
it'd've=it would have
it'll=it will
it'll've=it will have
it's=it is
let's=let us
ma'am=madam
mayn't=may not
might've=might have
mightn't=might not
mightn't've=might not have
must've=must have
mustn't=must not
mustn't've=must not have
needn't=need not
needn't've=need not have
o'clock=of the clock
oughtn't=ought not
oughtn't've=ought not have
shan't=shall not
sha'n't=shall not
shan't've=shall not have
she'd=she would
she'd've=she would have
she'll=she will
she'll've=she will have
she's=she is
should've=should have
shouldn't=should not
shouldn't've=should not have
so've=so have
so's=so as
that'd=that would
that'd've=that would have
that's=that is
there'd=there would
there'd've=there would have
there's=there is
they'd=they would
they'd've=they would have
they'll=they will
they'll've=they will have
they're=they are
they've=they have
to've=to have
wasn't=was not
we'd=we would
we'd've=we would have
we'll=we will
we'll've=we will have
we're=we are
we've=we have
weren't=were not
what'll=what will
what'll've=what will have
what're=what are
what's=what is
what've=what have
when's=when is
when've=when have
where'd=where did
where's=where is
where've=where have
who'll=who will
who'll've=who will have
who's=who is
who've=who have
why's=why is
why've=why have
will've=will have
won't=will not
won't've=will not have
would've=would have
wouldn't=would not
wouldn't've=would not have
y'all=you all
y'all'd=you all would
y'all'd've=you all would have
y'all're=you all are
y'all've=you all have
you'd=you would
you'd've=you would have
you'll=you will
you'll've=you will have
you're=you are
you've=you have
"""
CONTRACTIONS = dict(line.split("=") for line in _CONTRACTIONS.strip().splitlines())
CONTRACTION_PATTERN = "(?i)" + "|".join(sorted(CONTRACTIONS, key=lambda k: (-len(k), k)))

# Ordered rewrites for question text; each is (pattern, replacement).
QUESTION_REWRITES = [
    (r"[^A-Za-z0-9^,!./'+-=]", " "),
    (r"what's", "what is "),
    (r"'s", " "),
    (r"'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"i'm", "i am "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r",", " "),
    (r"\.", " "),
    (r"!", " ! "),
    (r"/", " "),
    (r"\^", " ^ "),
    (r"\+", " + "),
    (r"-", " - "),
    (r"=", " = "),
    (r"'", " "),
    (r"(\d+)(k)", r"$1000"),
    (r":", " : "),
    (r" e g ", " eg "),
    (r" b g ", " bg "),
    (r" u s ", " american "),
    (r"\x00s", "0"),
    (r" 9 11 ", "911"),
    (r"e - mail", "email"),
    (r"j k", "jk"),
    (r"\s{2,}", " "),
]

# Rewrites that isolate punctuation in one labelled line.
LINE_REWRITES = [
    (r"'", " ' "),
    (r'"', ""),
    (r"\.", " . "),
    (r"<br />", " "),
    (r",", " , "),
    (r"\(", " ( "),
    (r"\)", " ) "),
    (r"!", " ! "),
    (r"\?", " ? "),
    (r";", " "),
    (r":", " "),
    (r" +", " "),
]

# Rewrites that strip wiki markup and leave lower-case letters and spaces.
WIKI_REWRITES = [
    (r"<[^>\n]*>", ""),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"(?i)\|thumb", ""),
    (r"(?i)\|left", ""),
    (r"(?i)\|right", ""),
    (r"(?i)\|\d+px", ""),
    (r"(?i)\[\[image:[^\[\]]*\|", ""),
    (r"(?i)\[\[category:([^|\]]*)[^\]]*\]\]", r"[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
]
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()

# Character ids: the place in this string, from 1. Padding is 0, anything else is OTHER_CHAR_ID.
CHAR_ALPHABET = "abcdefghijklmnoprstuvzxywq-.,!?_$&)(+\"' "
OTHER_CHAR_ID = 41

# Inline document tags and the word that stands for each.
INLINE_TAGS = {
    "MIES": "NIMI_MIES",
    "NAINEN": "NIMI_NAINEN",
    "NETTISIVU": "VIITE_NETTI",
    "JULKAISU": "VIITE_TIEDEJULKAISU",
    "YLIOPISTO": "NIMI_YLIOPISTO",
    "YRITYS": "NIMI_YRITYS",
    "TAULUKKO": "TAULUKKO",
}

# 32-bit string hash and n-gram combination constants.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
NGRAM_PRIME = 116049371
HASH_BUCKETS = 2000000
