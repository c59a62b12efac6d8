from textloom.operators import stem

# Published examples of the algorithm.
PAIRS = """caresses=caress ponies=poni ties=ti caress=caress cats=cat feed=feed agreed=agre
plastered=plaster bled=bled motoring=motor sing=sing conflated=conflat troubled=troubl sized=size
hopping=hop tanned=tan falling=fall hissing=hiss fizzed=fizz failing=fail filing=file happy=happi
sky=sky relational=relat conditional=condit rational=ration valenci=valenc digitizer=digit
radicalli=radic differentli=differ vileli=vile analogousli=analog vietnamization=vietnam
predication=predic operator=oper feudalism=feudal decisiveness=decis hopefulness=hope
callousness=callous formaliti=formal sensitiviti=sensit sensibiliti=sensibl triplicate=triplic
formative=form formalize=formal electriciti=electr electrical=electr hopeful=hope goodness=good
revival=reviv allowance=allow inference=infer airliner=airlin gyroscopic=gyroscop
adjustable=adjust defensible=defens irritant=irrit replacement=replac adjustment=adjust
dependent=depend adoption=adopt homologou=homolog communism=commun activate=activ
angulariti=angular homologous=homolog effective=effect bowdlerize=bowdler probate=probat rate=rate
cease=ceas controll=control roll=roll is=is by=by generalizations=gener oscillators=oscil"""


def test_porter_examples(spark):
    want = dict(p.split("=") for p in PAIRS.split())
    df = spark.createDataFrame([(w,) for w in want], "term string")
    got = {r.term: r.stem for r in stem.stems(df).collect()}
    assert got == want


# Published samples of the algorithms: words and their stems.
SNOWBALL = {
    "en": """consign=consign consigned=consign consigning=consign consignment=consign consist=consist
consisted=consist consistency=consist consistently=consist consolation=consol consolatory=consolatori
consoled=consol consolidating=consolid consolingly=consol consols=consol consonant=conson consorting=consort
conspicuously=conspicu conspiracy=conspiraci conspirators=conspir conspiring=conspir constables=constabl
constance=constanc constancy=constanc constant=constant knackeries=knackeri knaves=knave knavish=knavish
kneaded=knead kneeling=kneel knightly=knight knitted=knit knives=knive knobs=knob knocker=knocker
knockers=knocker knocking=knock knots=knot skies=sky dying=die generously=generous news=news
inning=inning proceed=proceed proceeding=proceed happy=happi say=say cry=cri by=by ties=tie gas=gas
hopping=hop hoping=hope luxuriating=luxuri agreed=agre""",
    "fr": """continua=continu continuellement=continuel continuité=continu continuons=continuon
contorsions=contors contournant=contourn contractées=contract contradictoirement=contradictoir
contraindre=contraindr contraire=contrair contraria=contrari maintenaient=mainten maintenue=maintenu
maintint=maintint maires=mair maïs=maï maison=maison maître=maîtr maîtresses=maîtress majesté=majest
majestueusement=majestu majestueux=majestu majeure=majeur majorité=major malacca=malacc malade=malad
maladive=malad""",
    "de": """aufeinanderbiß=aufeinanderbiss aufeinanderfolgenden=aufeinanderfolg aufeinanderfolgt=aufeinanderfolgt
aufeinanderschlügen=aufeinanderschlug aufenthaltes=aufenthalt auferlegten=auferlegt auferstand=auferstand
auferstehung=aufersteh auferweckung=auferweck auffallender=auffall auffällig=auffall auffaßt=auffasst
auffassungsvermögen=auffassungsvermog kategorien=kategori kategorischer=kategor katers=kat
kathedrale=kathedral katholischen=kathol kattunhalstücher=kattunhalstuch kätzchens=katzch
katzensprung=katzenspr kauerte=kauert käuflich=kauflich kaufmann=kaufmann""",
    "es": """checar=chec checoslovaquia=checoslovaqui chemise=chemis chequeo=cheque cheques=chequ
chetumaleños=chetumaleñ chicana=chican chicharrones=chicharron torá=tor tórax=torax torcer=torc
toreándolo=tor torearlo=tor toreó=tore toreros=torer tormentas=torment tornados=torn tornen=torn torneos=torne
tornillos=tornill torniquete=torniquet torpedearon=torped torpeza=torpez torrenciales=torrencial
torreón=torreon torrescano=torrescan""",
}


def test_snowball_samples(spark):
    want = {(lang, w): s for lang, text in SNOWBALL.items() for w, s in (p.split("=") for p in text.split())}
    want |= {("xx", "running"): "running", (None, "running"): "running", ("en", ""): "", ("de", "ab"): "ab"}
    df = spark.createDataFrame(list(want), "lang string, term string")
    got = {(r.lang, r.term): r.stem for r in stem.snowball_stems(df).collect()}
    assert got == want


def test_tokens_keep_their_rows_when_one_word_is_everywhere(spark):
    rows = [(i, "en", "running", 1) for i in range(300)] + [(i, "de", "katzen", 2) for i in range(5)] + [(9, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, term string, tf long")
    got = sorted((r.doc_id, r.lang or "", r.term, r.tf, r.stem) for r in stem.snowball_tokens(df).collect())
    stems = {"running": "run", "katzen": "katz", "x": "x"}
    assert got == sorted((i, lang or "", w, n, stems[w]) for i, lang, w, n in rows)
