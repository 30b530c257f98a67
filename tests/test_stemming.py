"""Stems against known pairs of the English Snowball vocabulary."""

from vitals.operators.stemming import with_stems

# Words and their stems.
PAIRS = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist,
consistency consist, consistent consist, consistently consist, consisting consist, consists consist, consolation consol,
consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid,
consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson,
consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu,
conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead,
kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt,
knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit,
knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker,
knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot,
caresses caress, flies fli, dies die, ties tie, cries cri, gas gas, gaps gap, kiwis kiwi, this this, agreed agre, feed feed,
luxuriated luxuri, hopping hop, hoped hope, hoping hope, falling fall, bees bee, running run, cry cri, by by, say say,
happily happili, generate generat, generous generous, communism communism, arsenal arsenal, relational relat,
conditional condit, rationalize ration, hopefulness hope, sensibility sensibl, apology apolog, national nation,
skies sky, dying die, news news, inning inning, innings inning, proceeds proceed, exceeding exceed, only onli, at at,
a a, young young, youth youth, boyish boyish, yes yes, controll control, rolled roll, fluently fluentli, adjustment adjust,
replacement replac, irritable irrit, activate activ, adoption adopt, electrical electr, goodness good, formative format
"""


def test_known_stems(spark):
    pairs = dict(p.split() for p in PAIRS.replace("\n", " ").split(","))
    got = {r["term"]: r["stem"] for r in with_stems(spark.createDataFrame([(w, 1) for w in pairs], "term string, n int")).collect()}
    assert {w: got[w] for w in pairs if got[w] != pairs[w]} == {}


def test_other_words_stay(spark):
    words = ["", "x1", "42", "日本語", "é"]
    got = with_stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()
    assert [r["stem"] for r in got] == words


def test_rules_of_regions_and_last_letters(spark):
    pairs = {"yyyy": "yyyi", "enjoyyed": "enjoyi", "played": "play", "analogi": "analog", "ogi": "ogi", "singli": "sing", "mildli": "mild",
             "ali": "ali", "station": "station", "opinion": "opinion", "creed": "creed", "agreedly": "agre", "sized": "size", "hissing": "hiss",
             "native": "nativ", "relative": "relat", "proceed": "proceed", "succeeds": "succeed", "ring": "ring", "seing": "se", "us": "us",
             "buses": "buse", "gus": "gus"}
    got = {r["term"]: r["stem"] for r in with_stems(spark.createDataFrame([(w,) for w in [*pairs, None]], "term string")).collect()}
    assert got == {**pairs, None: None}


def test_code_is_short_enough_for_the_jvm_to_compile(spark):
    """A row with a term, its block and its occurrences; longer methods run interpreted, at twice the time or more."""
    df = with_stems(spark.range(1).selectExpr("if(id = 0, null, cast(id as string)) term", "cast(id as string) repo_name", "cast(id as int) number", "id block", "cast(cast(id as string) as binary) pairs"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000
