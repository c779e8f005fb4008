"""The stemmer on words whose stems are published with the algorithm, and cover density by hand."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions.stemming import SPECIAL, STOPWORDS, lexemes, prefix, stem
from loomspan.operators import retrieval

PAIRS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist
consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol
consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir
constable constabl|constables constabl|constance constanc|constancy constanc|constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee
kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive
knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot
skies sky|dying die|news news|inning inning|proceed proceed|generously generous|communism communism|arsenal arsenal|happy happi|say say|by by|enjoy enjoy|hoping hope|hopping hop|ties tie|cries cri|gas gas|this this|kiwis kiwi|gaps gap
running run|tables tabl|table tabl|storing store|store store|relational relat|bed bed|shed shed|dropped drop|luxuriated luxuri|agreed agre|ability abil"""


def test_published_stems():
    for pair in PAIRS.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert stem(word) == want, word


def test_words_begin_with_the_prefix_of_their_stem():
    ends = ["", "s", "es", "ed", "ing", "ly", "ness", "ational", "ization", "fulness", "ousli", "ability", "ities", "ies", "y", "ement", "ically", "iveness", "logy", "'s", "eedly", "ied"]
    words = [w + e for w in ["rel", "hop", "happ", "cr", "sens", "form", "gener", "agr", "tabl", "kn", "possib", "bio", "a", "be", "sk", "d", "triv"] for e in ends] + [x.split()[0] for x in PAIRS.replace("\n", "|").split("|")]
    assert all(w.startswith(prefix(stem(w))) for w in [*words, *SPECIAL])


def test_lexemes():
    assert lexemes("The tables, and the RUNNING 12") == [(2, "tabl"), (5, "run"), (6, "12")] and "the" in STOPWORDS
    assert lexemes("") == [] and lexemes("ÜBER straße") == [(1, "über"), (2, "straße")]


@pytest.mark.parametrize(
    ("query", "title", "content", "rank"),
    [
        ("table", "a table", "", 1.0),  # one cover of one word of weight A
        ("table", "", "a table here", 0.2),  # weight C
        ("store tables", "", "store big tables", 0.1),  # 2 / (5 + 5) over 1 + 1 noise word
        ("store tables", "store", "tables", 1 / 3),  # title and content are one text: 2 / (1 + 5), no noise
        ("table or row", "table row", "", 2.0),  # two covers
        ('"store tables"', "store tables", "store x tables", 1.0),  # only neighbours
        ('"store the tables"', "store the tables", "", 0.5),  # a stop word counts as a place
        ("tables -row", "tables", "", 1.0),
    ],
)
def test_cover_density(spark, query, title, content, rank):
    docs = spark.createDataFrame([(1, title, None, content), (2, "nothing", None, "here")], "id long, title string, summary string, content string")
    got = retrieval.match(docs, query).collect()
    assert [r.id for r in got] == [1] and abs(got[0]["rank"] - rank) < 1e-6


def test_match_is_whole_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "row " * 3, None, "x " * 20_000 + "needle", 7), (None, None, None, None, 8), (2, "tables row", "", "", 9)], "id long, title string, summary string, content string, extra int")
    assert [(r.id, r.extra) for r in retrieval.match(docs, "needle row").collect()] == [(1, 7)]
    assert {r.id for r in retrieval.match(docs, "row -tables").collect()} == {1}
    assert retrieval.match(docs, "the and").collect() == [] and retrieval.match(docs.limit(0), "row").collect() == []
    found = retrieval.index(docs).where(F.col("term") == "tabl").collect()
    assert [(r.id, r.field, r.positions) for r in found] == [(2, "title", [1])]
    assert [r.id for r in retrieval.search_index(retrieval.index(docs), "needle row").collect()] == [1]
