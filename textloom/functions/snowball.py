"""Snowball stemmers of English, French, German and Spanish as one expression per language.

The published algorithms mark regions of a word (RV, R1, R2) and then, step by step, look for the
longest of a list of suffixes. "The longest suffix" is the leftmost match of an alternation tied to
the word's end, so each step is one regular expression and one CASE over what it found. A word and its
region marks travel from step to step as a struct, bound once per step as a lambda variable.

The expressions are SQL text, for Spark and for the engine that the queries are compared with: they
differ in quoting, lambdas, structs and the names of the pattern functions only.
"""

from pyspark.sql import functions as F

EN_V, FR_V, DE_V, ES_V = "aeiouy", "aeiouyâàëéêèïîôûù", "aeiouyäöü", "aeiouáéíóúü"

# Fixed values of the published algorithms: suffixes with their replacements, and exceptions.
EN_WHOLE = """skis=ski skies=sky dying=die lying=lie tying=tie idly=idl gently=gentl ugly=ugli early=earli
only=onli singly=singl sky=sky news=news howe=howe atlas=atlas cosmos=cosmos bias=bias andes=andes"""
EN_LATE = "inning outing canning herring earring proceed exceed succeed"
EN_2 = """tional=tion enci=ence anci=ance abli=able entli=ent izer=ize ization=ize ational=ate ation=ate
ator=ate alism=al aliti=al alli=al fulness=ful ousli=ous ousness=ous iveness=ive iviti=ive biliti=ble
bli=ble fulli=ful lessli=less"""
EN_3 = "tional=tion ational=ate alize=al icate=ic iciti=ic ical=ic ful= ness="
EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"

FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
FR_ATE = "atrice ateur ation atrices ateurs ations"
FR_I_VERB = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is
issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"""
FR_E_VERB = """é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"""
FR_A_VERB = """âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"""

ES_PRONOUN = "me se sela selo selas selos la le lo las les los nos"
ES_ACUTE = "iéndo=iendo ándo=ando ár=ar ér=er ír=ir"
ES_PLAIN = """anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas
amiento amientos imiento imientos"""
ES_ATE = "adora ador ación adoras adores aciones ante antes ancia ancias"
ES_Y_VERB = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
ES_VERB = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis
eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera
ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as
abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos
amos ábamos íamos imos áramos iéramos iésemos ásemos"""


def _pairs(text):
    return dict(p.split("=") for p in text.split())


def cut(w, n):
    return f"left({w}, length({w}) - {n})"


def inside(w, n, region):
    """The last n letters lie in the region."""
    return f"length({w}) - {n} >= s.{region}"


class Spark:
    """Writes the expressions for Spark."""

    @staticmethod
    def q(text):
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def matches(self, w, pattern):
        return f"regexp_like({w}, {self.q(pattern)})"

    def found(self, w, pattern):
        return f"regexp_extract({w}, {self.q('(' + pattern + ')')}, 1)"

    def replace(self, w, pattern, by):
        return f"regexp_replace({w}, {self.q(pattern)}, {self.q(by)})"

    def let(self, name, value, body):
        return f"transform(array({value}), {name} -> {body})[0]"

    def struct(self, **values):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


class Duck(Spark):
    """Writes the expressions for the engine of the comparison."""

    @staticmethod
    def q(text):
        return "'" + text.replace("'", "''") + "'"

    def matches(self, w, pattern):
        return f"regexp_matches({w}, {self.q(pattern)})"

    def replace(self, w, pattern, by):
        return f"regexp_replace({w}, {self.q(pattern)}, {self.q(by.replace('$', chr(92)))}, 'g')"

    def let(self, name, value, body):
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def struct(self, **values):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


class Language:
    def __init__(self, dialect):
        self.d = dialect

    def suffix(self, suffixes, w="s.w"):
        """The longest of the suffixes that the word ends with, or the empty text."""
        return self.d.found(w, "(?:" + "|".join(suffixes) + ")$")

    def among(self, names):
        return "(" + ", ".join(self.d.q(n) for n in names) + ")"

    def ends(self, w, suffix):
        return f"{w} LIKE {self.d.q('%' + suffix)}"

    def drop(self, w, suffix, region, otherwise=None):
        """The word without the suffix if that lies in the region."""
        n = len(suffix)
        return (f"CASE WHEN NOT ({self.ends(w, suffix)}) THEN {w} WHEN {inside(w, n, region)} THEN {cut(w, n)} "
                f"ELSE {otherwise or w} END")

    def first(self, w, *patterns):
        """Length of the first pattern's match at the word's start, else of the whole word."""
        return self.d.let("p", self.d.found(w, "^(?:" + "|".join(patterns) + ")"),
                          f"CASE WHEN p = '' THEN length({w}) ELSE length(p) END")

    def standard(self, w, v):
        """Mark after the first non-vowel that follows a vowel."""
        return self.first(w, f".*?[{v}][^{v}]")

    def chain(self, word, marks, steps):
        """Apply steps to a marked word; a step gives the new word, or (word, flag)."""
        keep = {k: f"s.{k}" for k in marks}
        state = self.d.let("w", word, self.d.struct(w="w", f="0", **{k: "0" for k in marks}))
        for k, mark in marks.items():
            state = self.d.let("s", state, self.d.struct(w="s.w", f="s.f", **(keep | {k: mark})))
        for step in steps:
            w, flag = step if isinstance(step, tuple) else (step, "s.f")
            state = self.d.let("s", state, self.d.struct(w=w, f=flag, **keep))
        return self.d.let("s", state, "s.w")

    def marks(self, v, rv=None, r1=None):
        out = {"rv": rv} if rv else {}
        second = f"(s.r1 + {self.standard('substr(s.w, s.r1 + 1)', v)})"
        return out | {"r1": r1 or self.standard("s.w", v), "r2": second}


class English(Language):
    def stem(self, word):
        d, v = self.d, EN_V
        whole = " ".join(f"WHEN {d.q(a)} THEN {d.q(b)}" for a, b in _pairs(EN_WHOLE).items())
        rest = self.chain(self.prelude(word), self.marks(v, r1=self.r1()), [
            d.let("e", d.found("s.w", "(?:'s'|'s|')$"), cut("s.w", "length(e)")),
            (self.step1a(), f"CASE WHEN {self.step1a()} IN {self.among(EN_LATE.split())} THEN 1 ELSE 0 END"),
            *[f"CASE WHEN s.f = 1 THEN s.w ELSE {x} END" for x in (
                self.step1b(), self.step1c(), self.step2(), self.step3(), self.step4(), self.step5())]])
        return (f"CASE WHEN length({word}) <= 2 THEN {word} ELSE CASE {word} {whole} "
                f"ELSE {d.replace(rest, 'Y', 'y')} END END")

    def prelude(self, word):
        d = self.d
        return d.replace(d.replace(d.replace(word, "^'", ""), "^y", "Y"), f"([{EN_V}])y", "$1Y")

    def r1(self):
        return self.first("s.w", "gener", "commun", "arsen", f".*?[{EN_V}][^{EN_V}]")

    def step1a(self):
        body = (f"CASE WHEN e = 'sses' THEN {cut('s.w', 2)} "
                f"WHEN e IN ('ied', 'ies') THEN CASE WHEN length(s.w) > 4 THEN {cut('s.w', 2)} ELSE {cut('s.w', 1)} END "
                f"WHEN e = 's' AND {self.d.matches(cut('s.w', 2), f'[{EN_V}]')} THEN {cut('s.w', 1)} ELSE s.w END")
        return self.d.let("e", self.suffix(["sses", "ied", "ies", "us", "ss", "s"]), body)

    def step1b(self):
        d, v = self.d, EN_V
        short = f"s.r1 >= length(t) AND {self.short('t')}"
        mended = (f"CASE WHEN {d.matches('t', '(at|bl|iz)$')} THEN t || 'e' "
                  f"WHEN {d.matches('t', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {cut('t', 1)} "
                  f"WHEN {short} THEN t || 'e' ELSE t END")
        body = d.let("t", cut("s.w", "length(e)"), f"CASE WHEN e = '' THEN s.w "
                     f"WHEN e LIKE 'eed%' THEN CASE WHEN length(t) >= s.r1 THEN t || 'ee' ELSE s.w END "
                     f"WHEN {d.matches('t', f'[{v}]')} THEN {mended} ELSE s.w END")
        return d.let("e", self.suffix(["eed", "eedly", "ed", "edly", "ing", "ingly"]), body)

    def short(self, w):
        """The word ends in a short syllable."""
        return self.d.matches(w, f"([^{EN_V}][{EN_V}][^{EN_V}wxY]|^[{EN_V}][^{EN_V}])$")

    def step1c(self):
        return f"CASE WHEN {self.d.matches('s.w', f'.[^{EN_V}][yY]$')} THEN {cut('s.w', 1)} || 'i' ELSE s.w END"

    def mapped(self, table, more=(), cases=""):
        """Replace the longest suffix in R1 by its entry of the table."""
        when = " ".join(f"WHEN e = {self.d.q(a)} THEN t || {self.d.q(b)}" for a, b in table.items())
        body = self.d.let("t", cut("s.w", "length(e)"), f"CASE WHEN e = '' OR length(t) < s.r1 THEN s.w "
                          f"{when} {cases} ELSE s.w END")
        return self.d.let("e", self.suffix([*table, *more]), body)

    def step2(self):
        cases = (f"WHEN e = 'ogi' AND t LIKE '%l' THEN t || 'og' "
                 f"WHEN e = 'li' AND {self.d.matches('t', '[cdeghkmnrt]$')} THEN t")
        return self.mapped(_pairs(EN_2), ["ogi", "li"], cases)

    def step3(self):
        return self.mapped(_pairs(EN_3), ["ative"], "WHEN e = 'ative' AND length(t) >= s.r2 THEN t")

    def step4(self):
        body = self.d.let("t", cut("s.w", "length(e)"), "CASE WHEN e = '' OR length(t) < s.r2 THEN s.w "
                          "WHEN e <> 'ion' OR t LIKE '%s' OR t LIKE '%t' THEN t ELSE s.w END")
        return self.d.let("e", self.suffix([*EN_4.split(), "ion"]), body)

    def step5(self):
        t = cut("s.w", 1)
        return self.d.let("t", t, f"CASE WHEN s.w LIKE '%e' AND (length(t) >= s.r2 OR (length(t) >= s.r1 AND NOT "
                          f"{self.short('t')})) THEN t WHEN s.w LIKE '%ll' AND length(t) >= s.r2 THEN t ELSE s.w END")


class French(Language):
    def stem(self, word):
        d, v = self.d, FR_V
        rv = self.first("s.w", f"[{v}][{v}].", "par", "col", "tap", f"..*?[{v}]")
        out = self.chain(self.prelude(word), self.marks(v, rv=rv), [
            self.step1(), self.i_verb(), self.verb(),
            f"CASE WHEN s.f = 0 THEN {self.residual_s()} WHEN s.w LIKE '%Y' THEN {cut('s.w', 1)} || 'i' "
            f"WHEN s.w LIKE '%ç' THEN {cut('s.w', 1)} || 'c' ELSE s.w END",
            f"CASE WHEN s.f = 0 THEN {self.residual()} ELSE s.w END",
            f"CASE WHEN {d.matches('s.w', '(enn|onn|ett|ell|eill)$')} THEN {cut('s.w', 1)} ELSE s.w END",
            d.replace("s.w", f"[éè]([^{v}]+)$", "e$1")])
        return f"translate({out}, 'IUY', 'iuy')"

    def prelude(self, word):
        d, v = self.d, FR_V
        w = d.replace(word, "qu", "qU")
        for pattern, by in ((f"([{v}])y", "$1Y"), (f"y([{v}])", "Y$1"), (f"([{v}])u([{v}])", "$1U$2"),
                            (f"([{v}])i([{v}])", "$1I$2")):
            w = d.replace(w, pattern, by)
        return w

    def step1(self):
        d = self.d
        a, b = FR_PLAIN.split(), FR_ATE.split()
        every = [*a, *b, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements",
                 "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements",
                 "amment", "emment", "ment", "ments"]
        r1, r2, rv = (f"length(t) >= s.{r}" for r in ("r1", "r2", "rv"))
        to_iqu = lambda w: self.drop(w, "ic", "r2", f"{cut(w, 2)} || 'iqU'")
        after_iv = d.let("u", cut("t", 2), self.drop("u", "at", "r2"))
        ement = (f"CASE WHEN t LIKE '%iv' THEN CASE WHEN {inside('t', 2, 'r2')} THEN {after_iv} ELSE t END "
                 f"WHEN t LIKE '%eus' THEN CASE WHEN {inside('t', 3, 'r2')} THEN {cut('t', 3)} "
                 f"WHEN {inside('t', 3, 'r1')} THEN {cut('t', 3)} || 'eux' ELSE t END "
                 f"WHEN t LIKE '%abl' THEN {self.drop('t', 'abl', 'r2')} "
                 f"WHEN t LIKE '%iqU' THEN {self.drop('t', 'iqU', 'r2')} "
                 f"WHEN {d.matches('t', '[iI]èr$')} AND {inside('t', 3, 'rv')} THEN {cut('t', 3)} || 'i' ELSE t END")
        ite = (f"CASE WHEN t LIKE '%abil' THEN {self.drop('t', 'abil', 'r2', cut('t', 4) + chr(32) + '|| ' + d.q('abl'))} "
               f"WHEN t LIKE '%ic' THEN {to_iqu('t')} ELSE {self.drop('t', 'iv', 'r2')} END")
        after_at = d.let("u", cut("t", 2), to_iqu("u"))
        ive = f"CASE WHEN t LIKE '%at' AND {inside('t', 2, 'r2')} THEN {after_at} ELSE t END"
        done, left = (lambda w: d.struct(w=w, f="1")), d.struct(w="s.w", f="0")
        undone = lambda w: d.struct(w=w, f="0")
        body = (
            f"CASE WHEN e = '' THEN {left} "
            f"WHEN e IN {self.among(a)} AND {r2} THEN {done('t')} "
            f"WHEN e IN {self.among(b)} AND {r2} THEN {done(to_iqu('t'))} "
            f"WHEN e LIKE 'logie%' AND {r2} THEN {done('t || ' + d.q('log'))} "
            f"WHEN e LIKE 'u_ion%' AND {r2} THEN {done('t || ' + d.q('u'))} "
            f"WHEN e LIKE 'ence%' AND {r2} THEN {done('t || ' + d.q('ent'))} "
            f"WHEN e IN ('ement', 'ements') AND {rv} THEN {done(ement)} "
            f"WHEN e IN ('ité', 'ités') AND {r2} THEN {done(ite)} "
            f"WHEN e IN ('if', 'ive', 'ifs', 'ives') AND {r2} THEN {done(ive)} "
            f"WHEN e = 'eaux' THEN {done('t || ' + d.q('eau'))} "
            f"WHEN e = 'aux' AND {r1} THEN {done('t || ' + d.q('al'))} "
            f"WHEN e LIKE 'euse%' AND {r2} THEN {done('t')} "
            f"WHEN e LIKE 'euse%' AND {r1} THEN {done('t || ' + d.q('eux'))} "
            f"WHEN e LIKE 'issement%' AND {r1} AND {d.matches('t', f'[^{FR_V}]$')} THEN {done('t')} "
            f"WHEN e = 'amment' AND {rv} THEN {undone('t || ' + d.q('ant'))} "
            f"WHEN e = 'emment' AND {rv} THEN {undone('t || ' + d.q('ent'))} "
            f"WHEN e IN ('ment', 'ments') AND {d.matches('t', f'[{FR_V}]$')} AND {inside('t', 1, 'rv')} "
            f"THEN {undone('t')} ELSE {left} END")
        out = d.let("e", self.suffix(every), d.let("t", cut("s.w", "length(e)"), body))
        return d.let("o", out, "o.w"), d.let("o", out, "o.f")

    def _in_rv(self, suffixes, keep):
        """(word, flag): what is left of RV before the longest suffix found there, where it may go."""
        d = self.d
        part = "substr(s.w, s.rv + 1)"
        kept = d.let("e", self.suffix(suffixes, part), d.let("t", cut(part, "length(e)"), keep))
        w = d.let("k", kept, "CASE WHEN s.f > 0 OR k IS NULL THEN s.w ELSE left(s.w, s.rv) || k END")
        return w, d.let("k", kept, "CASE WHEN s.f > 0 THEN s.f WHEN k IS NULL THEN 0 ELSE 2 END")

    def i_verb(self):
        return self._in_rv(FR_I_VERB.split(),
                           f"CASE WHEN e <> '' AND {self.d.matches('t', f'[^{FR_V}]$')} THEN t END")

    def verb(self):
        e_verb, a_verb = FR_E_VERB.split(), FR_A_VERB.split()
        return self._in_rv(["ions", *e_verb, *a_verb], (
            f"CASE WHEN e = 'ions' THEN CASE WHEN s.rv + length(t) >= s.r2 THEN t END "
            f"WHEN e IN {self.among(e_verb)} THEN t "
            f"WHEN e <> '' THEN CASE WHEN t LIKE '%e' THEN {cut('t', 1)} ELSE t END END"))

    def residual_s(self):
        return f"CASE WHEN {self.d.matches('s.w', '[^aiouès]s$')} THEN {cut('s.w', 1)} ELSE s.w END"

    def residual(self):
        d = self.d
        part = "substr(s.w, s.rv + 1)"
        keep = (f"CASE WHEN e = '' THEN s.w WHEN e = 'ion' THEN CASE WHEN s.rv + length(t) >= s.r2 AND "
                f"(t LIKE '%s' OR t LIKE '%t') THEN left(s.w, s.rv) || t ELSE s.w END "
                f"WHEN e = 'e' THEN left(s.w, s.rv) || t ELSE left(s.w, s.rv) || t || 'i' END")
        return d.let("e", self.suffix(["ion", "ier", "ière", "Ier", "Ière", "e"], part),
                     d.let("t", cut(part, "length(e)"), keep))


class German(Language):
    def stem(self, word):
        d, v = self.d, DE_V
        w = d.replace(word, "ß", "ss")
        for c in "uy":
            w = d.replace(w, f"([{v}]){c}([{v}])", f"$1{c.upper()}$2")
        # R2 starts from the plain R1, which is then moved so that three letters stand before it.
        marks = {"r0": f"CASE WHEN length(s.w) < 3 THEN length(s.w) ELSE {self.standard('s.w', v)} END",
                 "r1": "greatest(s.r0, 3)",
                 "r2": f"(s.r0 + {self.standard('substr(s.w, s.r0 + 1)', v)})"}
        out = self.chain(w, marks, [self.step1(), self.step2(), self.step3()])
        return f"translate({out}, 'UYäöü', 'uyaou')"

    def step1(self):
        d = self.d
        body = (f"CASE WHEN e = '' OR length(t) < s.r1 THEN s.w WHEN e IN ('em', 'ern', 'er') THEN t "
                f"WHEN e = 's' THEN CASE WHEN {d.matches('t', '[bdfghklmnrt]$')} THEN t ELSE s.w END "
                f"WHEN t LIKE '%niss' THEN {cut('t', 1)} ELSE t END")
        return d.let("e", self.suffix(["em", "ern", "er", "e", "en", "es", "s"]),
                     d.let("t", cut("s.w", "length(e)"), body))

    def step2(self):
        d = self.d
        body = (f"CASE WHEN e = '' OR length(t) < s.r1 THEN s.w WHEN e <> 'st' THEN t "
                f"WHEN {d.matches('t', '...[bdfghklmnt]$')} THEN t ELSE s.w END")
        return d.let("e", self.suffix(["en", "er", "est", "st"]), d.let("t", cut("s.w", "length(e)"), body))

    def step3(self):
        d = self.d
        ig = f"CASE WHEN t LIKE '%ig' AND t NOT LIKE '%eig' AND {inside('t', 2, 'r2')} THEN {cut('t', 2)} ELSE t END"
        er = f"CASE WHEN {d.matches('t', 'e[rn]$')} AND {inside('t', 2, 'r1')} THEN {cut('t', 2)} ELSE t END"
        lich = f"CASE WHEN t LIKE '%lich' THEN {self.drop('t', 'lich', 'r2')} ELSE {self.drop('t', 'ig', 'r2')} END"
        body = (f"CASE WHEN e = '' OR length(t) < s.r2 THEN s.w WHEN e IN ('end', 'ung') THEN {ig} "
                f"WHEN e IN ('ig', 'ik', 'isch') THEN CASE WHEN t LIKE '%e' THEN s.w ELSE t END "
                f"WHEN e = 'keit' THEN {lich} ELSE {er} END")
        return d.let("e", self.suffix(["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"]),
                     d.let("t", cut("s.w", "length(e)"), body))


class Spanish(Language):
    def stem(self, word):
        v = ES_V
        rv = self.first("s.w", f"[{v}][^{v}].*?[{v}]", f"[{v}][{v}].*?[^{v}]", f"[^{v}][^{v}].*?[{v}]",
                        f"[^{v}][{v}].")
        out = self.chain(word, self.marks(v, rv=rv), [
            self.pronoun(), self.step1(), self.y_verb(), self.verb(), self.residual()])
        return f"translate({out}, 'áéíóú', 'aeiou')"

    def pronoun(self):
        d = self.d
        acute = _pairs(ES_ACUTE)
        plain = " ".join(f"WHEN {d.q(a)} THEN {d.q(b)}" for a, b in acute.items())
        stems = [*acute, *acute.values(), "yendo"]
        ok = "e <> '' AND g <> '' AND length(t) - length(g) >= s.rv AND (g <> 'yendo' OR t LIKE '%uyendo')"
        body = (f"CASE WHEN {ok} THEN {cut('t', 'length(g)')} || CASE g {plain} ELSE g END ELSE s.w END")
        return d.let("e", self.suffix(ES_PRONOUN.split()), d.let(
            "t", cut("s.w", "length(e)"), d.let("g", self.suffix(stems, "t"), body)))

    def step1(self):
        d = self.d
        a, b = ES_PLAIN.split(), ES_ATE.split()
        every = [*a, *b, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades",
                 "iva", "ivo", "ivas", "ivos"]
        r1, r2 = (f"length(t) >= s.{r}" for r in ("r1", "r2"))

        def one_of(w, names):
            when = " ".join(f"WHEN {self.ends(w, n)} THEN {self.drop(w, n, 'r2')}" for n in names)
            return f"CASE {when} ELSE {w} END"

        after_iv = d.let("u", cut("t", 2), self.drop("u", "at", "r2"))
        amente = (f"CASE WHEN t LIKE '%iv' THEN CASE WHEN {inside('t', 2, 'r2')} THEN {after_iv} ELSE t END "
                  f"ELSE {one_of('t', ['os', 'ic', 'ad'])} END")
        body = (
            f"CASE WHEN e = '' THEN NULL WHEN e IN {self.among(a)} AND {r2} THEN t "
            f"WHEN e IN {self.among(b)} AND {r2} THEN {self.drop('t', 'ic', 'r2')} "
            f"WHEN e LIKE 'logía%' AND {r2} THEN t || 'log' "
            f"WHEN e IN ('ución', 'uciones') AND {r2} THEN t || 'u' "
            f"WHEN e LIKE 'encia%' AND {r2} THEN t || 'ente' "
            f"WHEN e = 'amente' AND {r1} THEN {amente} "
            f"WHEN e = 'mente' AND {r2} THEN {one_of('t', ['ante', 'able', 'ible'])} "
            f"WHEN e LIKE 'idad%' AND {r2} THEN {one_of('t', ['abil', 'ic', 'iv'])} "
            f"WHEN e LIKE 'iv%' AND {r2} THEN {self.drop('t', 'at', 'r2')} END")
        out = d.let("e", self.suffix(every), d.let("t", cut("s.w", "length(e)"), body))
        return (d.let("k", out, "coalesce(k, s.w)"),
                d.let("k", out, "CASE WHEN k IS NULL THEN 0 ELSE 1 END"))

    def _in_rv(self, suffixes, keep):
        """(word, flag): the word without the longest suffix in RV; `keep` is null where it stays."""
        d = self.d
        out = d.let("e", self.suffix(suffixes, "substr(s.w, s.rv + 1)"),
                    d.let("t", cut("s.w", "length(e)"), keep))
        return (d.let("k", out, "CASE WHEN s.f > 0 THEN s.w ELSE coalesce(k, s.w) END"),
                d.let("k", out, "CASE WHEN s.f > 0 THEN s.f WHEN k IS NULL THEN 0 ELSE 2 END"))

    def y_verb(self):
        return self._in_rv(ES_Y_VERB.split(), "CASE WHEN e <> '' AND t LIKE '%u' THEN t END")

    def verb(self):
        soft = ["en", "es", "éis", "emos"]
        return self._in_rv([*soft, *ES_VERB.split()], (
            f"CASE WHEN e = '' THEN NULL WHEN e IN {self.among(soft)} AND t LIKE '%gu' THEN {cut('t', 1)} ELSE t END"))

    def residual(self):
        d = self.d
        body = (f"CASE WHEN e IN ('e', 'é') AND t LIKE '%gu' AND {inside('t', 1, 'rv')} THEN {cut('t', 1)} ELSE t END")
        return d.let("e", self.suffix(["os", "a", "o", "á", "í", "ó", "e", "é"], "substr(s.w, s.rv + 1)"),
                     d.let("t", cut("s.w", "length(e)"), body))


LANGUAGES = {"en": English, "fr": French, "de": German, "es": Spanish}


def text(word, lang, dialect=None):
    """SQL of the stem of a lower-case word; words of other languages stay as they are."""
    dialect = dialect or Spark()
    when = " ".join(f"WHEN '{k}' THEN {of(dialect).stem(word)}" for k, of in LANGUAGES.items())
    return f"CASE {lang} {when} ELSE {word} END"


def stem(word: str, lang: str):
    """Stem of the word column by the language column, both given by name."""
    return F.expr(text(f"`{word}`", f"`{lang}`"))
