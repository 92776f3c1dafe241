import pytest

from voxframe.llm import pii

SHAPES = [
    ("email", "Write to tobin.k@mail.example, thanks"), ("email", "e-mail bertrand46 @ example.net if"), ("email", "a evander.e AT kontakt dot example ok"), ("email", "to fashkby[at]mail dot example, x"),
    ("email", "Contact: quentin27(@)mail.example"), ("email", "velasjo-c＠example.com"), ("email", "okirsquo AT mail (dot) example"),
    ("phone", "Call me on 310.555.0150."), ("phone", "tel +1 617 555 0170 around"), ("phone", "text (808) 555-0139 any"), ("phone", "text (617)5550192 any"), ("phone", "I left 4155550161 with"),
    ("phone", "number is 8 0 8 5 5 5 0 1 2 2 x"), ("phone", "ist 030/23125-278."), ("phone", "(030) 23125 567"), ("phone", "07700 900 106"), ("phone", "+33 6 39 98 78 64"), ("phone", "06.39.98.16.29"),
    ("id_number", "My social is 977.08.8377."), ("id_number", "DNI X0861127 ¿"), ("id_number", "card 00087709-J"), ("id_number", "RC-7864-9721-80"), ("id_number", "is rc7933-5917-79."),
    ("address", "live at 6665 Vereton Blvd."), ("address", "mail it to 4644 Osiridge Place Apt 3 My"), ("address", "house, 4311 W. Eskmere Lane –"), ("address", "i live at 7297 eskocombe ln."),
    ("address", "Vivo en Avenida Nevegate nº 30."), ("address", "Vivo en calle Zanerford 193."), ("address", "en c/ Normoor 80, 2º B."), ("address", "Ich wohne Orlelcombegasse 44."), ("address", "vor Fenelgate-Allee 157."),
    ("address", "J'habite au 112 bis, avenue Fenanwick."), ("address", "au 130 allée de Kestebrook."),
    ("address", "at 450 Martin Luther King Blvd."), ("address", "12 Oak Hill Road"), ("address", "1200 South Main Street"), ("address", "12 Cherry Tree Lane"), ("address", "calle Gran Vía 12"),
    ("address", "Av. de la Constitución 45"), ("address", "9 rue de la Grande Armée"), ("address", "calle de las Flores Nuevas 7"),
]
NOTHING = [
    "see @kelowshawcity or the app, version 2.10.4", "It cost 4 155 550 dollars in Hall", "Ticket 311-2041-00707 is open", "permit 6179-2009 expired", "lot 9222-54, block 727 Around Kelowmere Avenue",
    "A budget of $1,297,000 was promised", "since 03/04/2021.", "9098 people signed, 20 cars on Calddale Street", "My street runs from Linagate Blvd to Park", "opens at 8 My street runs", "block 312 Between Keloworth Street and Istaridge", "between 12th and 14th Street", "[hidden] and █████ and ***",
    "Llevo 33 años en Plaza Taminford", "I moved to Wilworth Dr 29 years ago",
]


@pytest.mark.parametrize("kind,text", SHAPES)
def test_shapes(kind, text):
    assert [k for k, *_ in pii.shaped(text)[0]] == [kind]


@pytest.mark.parametrize("text", NOTHING)
def test_what_is_none(text):
    assert pii.shaped(text)[0] == []


def corpus():
    said = [
        "My name is Wanda Kirsby.", "I told Tobin Kirsby twice.", "our landlord Wanda Velasjo does nothing.", "Ask for Tobin Q. Velasjo.", "Signed, Wanda Velasjo", "Thanks – Velasjo, Tobin", "Me llamo Wanda Kirsby.",
        "Tobin Kirsby from our building fell there.", "I told Mr. Kirsby twice.", "Tobin Velasjo ist dort gestürzt.",
    ]
    plain = ["The bus to Kelmoor Hall never runs twice a week.", "Madame Kelmoor School opens at 8", "My kids told me that Kelmoor Avenue got worse.", "older neighbors pay twice for everything", "Miss the old neighborhood", "The plan for the park"]
    rows = said + plain * 20 + ["wanda velasjo se cayó allí mismo.", "Yesterday Wanda Kirsby waved.", "Write to 12 Kelmoor Lane, wanda@mail.example", "Thanks – The Plan is good"]
    return [(f"1:1:{i}", t, f"  {t}\n") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(corpus(), "response_key string, response_text string, raw_text_original string")


def test_names_come_from_the_corpus(answers):
    got = {(r.response_key, r.field_name) for r in pii.found_kinds(answers).where("pii_kind = 'name'").collect()}
    named = {k for k, t, _ in corpus() if any(n in t.lower() for n in ("kirsby", "velasjo"))}
    assert got == {(k, f) for k in named for f in pii.FIELDS}


def test_redaction_keeps_the_rest(answers):
    got = {r.response_key: r for r in pii.redact(answers).collect()}
    keys = {t: k for k, t, _ in corpus()}
    one = got[keys["Write to 12 Kelmoor Lane, wanda@mail.example"]]
    assert one.response_text == "Write to [ADDRESS], [EMAIL]" and one.raw_text_original == "  Write to [ADDRESS], [EMAIL]\n"
    assert got[keys["Ask for Tobin Q. Velasjo."]].response_text == "Ask for [NAME]."
    assert got[keys["Madame Kelmoor School opens at 8"]].response_text == "Madame Kelmoor School opens at 8"
    assert len(got) == len(corpus())


def test_garbled_text_is_read_as_meant(spark):
    text = "  Ich wohne KelowmoorstraÃŸe 181. Vivo en calle Zanerford nÂº 12."
    df = spark.createDataFrame([("1:1:1", text, text)], "response_key string, response_text string, raw_text_original string")
    assert pii.redact(df).first().response_text == "  Ich wohne [ADDRESS]. Vivo en [ADDRESS]."


@pytest.mark.parametrize("more", [[], ["I told Yesterday Paper twice."]])
def test_a_common_capitalised_word_before_a_name(spark, more):
    """The pair with the common word is no name; the name beside it is one all the same."""
    texts = [t for _, t, _ in corpus()] + ["Yesterday the bus was late"] * 80 + more
    df = spark.createDataFrame([(f"1:1:{i}", t, t) for i, t in enumerate(texts)], "response_key string, response_text string, raw_text_original string")
    got = {r.response_text for r in pii.redact(df).collect()}
    assert "Yesterday [NAME] waved." in got and "Yesterday the bus was late" in got


STREETS = ["the way to kelmoor lane", "kelmoor lane is dark", "12 kelmoor lane", "12 people place a bin there", *["people say so, and people know"] * 40, "Der Gehweg ist eng", *["Auf dem Gehweg liegt Laub"] * 60, "Gehweg 3 auf", "Brückgasse 3 auf"]


def test_a_street_in_small_letters_is_disclosed_by_its_neighbours(spark):
    df = spark.createDataFrame([(f"1:1:{i}", t, None) for i, t in enumerate(STREETS)], "response_key string, response_text string, raw_text_original string")
    got = {r.response_text for r in pii.redact(df).collect()}
    assert {"[ADDRESS]", "[ADDRESS] auf", "12 people place a bin there", "Gehweg 3 auf"} <= got


def test_a_number_everybody_gives_is_public(spark):
    texts = [f"Call 415-555-{i:04d} now" for i in range(150)] + ["The office is 415-555-9999"] * 30
    df = spark.createDataFrame([(f"1:1:{i}", t, t) for i, t in enumerate(texts)], "response_key string, response_text string, raw_text_original string")
    got = [r.response_text for r in pii.redact(df).collect()]
    assert got.count("Call [PHONE] now") == 150 and got.count("The office is 415-555-9999") == 30
    one = spark.createDataFrame([("1:1:1", "Call 415-555-0001", None)], "response_key string, response_text string, raw_text_original string")
    assert pii.redact(one).first().response_text == "Call [PHONE]"


def introduced(n=12):
    """Names behind seeds, and in contexts that are nowhere listed."""
    first, last = [f"Wanda Tobin Kofi Anouk Ximena Priya".split()[i % 6] for i in range(n)], [f"Kirs{x}" for x in ("by", "jo", "quo", "eira", "wick", "ette", "ides", "inski", "more", "man", "ovic", "aldi")][:n]
    said = [t.format(f"{a} {b}") for i, (a, b) in enumerate(zip(first, last)) for t in ("My name is {}.", "the caretaker {} never answers.", "{} slipped on the stairs.")]
    plain = ["the caretaker Kelmoor Hall has is fine", "Kelmoor Hall slipped in the ranking"] + ["The bus to Kelmoor Hall never comes"] * 30
    return said, plain


@pytest.mark.parametrize("text,redacted", [
    ("the caretaker wanda kirsby never answers", "the caretaker [NAME] never answers"), ("TOBIN KIRSJO SLIPPED ON THE STAIRS", "[NAME] SLIPPED ON THE STAIRS"),
    ("the caretaker Wanda de la Kirsby never answers", "the caretaker [NAME] never answers"), ("Ask the caretaker Kofi Anouk Kirsby now", "Ask the caretaker [NAME] now"),
    ("the caretaker and the bus never come", "the caretaker and the bus never come"), ("At Kelmoor Hall it is dark", "At Kelmoor Hall it is dark"),
])
def test_contexts_are_learned(spark, text, redacted):
    said, plain = introduced()
    df = spark.createDataFrame([(f"1:1:{i}", t, None) for i, t in enumerate([*said, *plain, text])], "response_key string, response_text string, raw_text_original string")
    got = {r.response_text for r in pii.redact(df).collect()}
    assert redacted in got
    assert {"the caretaker [NAME] never answers.", "[NAME] slipped on the stairs.", "The bus to Kelmoor Hall never comes"} <= got


def test_an_apostrophe_belongs_to_the_name():
    assert {(w, o) for _, _, w, o, _ in pii.candidates("I met Jane O'Neil there")} == {("jane", "neil")}
    assert {text[b:e] for text in ("So Maria del Carmen Lopez said",) for b, e, *_ in pii.candidates(text)} >= {"Maria del Carmen", "Carmen Lopez"}


def test_batches_decide_nothing(spark):
    """The same whatever the size of an Arrow batch."""
    said, plain = introduced()
    df = spark.createDataFrame([(f"1:1:{i}", t, None) for i, t in enumerate([*said, *plain, *STREETS])], "response_key string, response_text string, raw_text_original string")
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for size in (1, 1000):
        spark.conf.set(name, size)
        found.append(sorted(map(tuple, pii.spans(df).collect())))
    spark.conf.set(name, before)
    assert found[0] == found[1] and found[0]


def test_overlapping_candidates_all_come_out():
    assert {(w, o) for _, _, w, o, _ in pii.candidates("Yesterday Wanda Kirsby waved.")} == {("yesterday", "wanda"), ("wanda", "kirsby")}
