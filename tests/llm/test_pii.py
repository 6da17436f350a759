import random

import pytest

from jsonloom.llm import pii as P

NAMES = ["Tamsin Fenmore", "Percy Marrick", "Iris Dunleary", "Jasper Lathbury"]


@pytest.fixture(scope="module")
def model():
    texts = [f"Contact: {n}, now. My name is {n} and I live here. Regards, {n}\nPlease send it. The drill is fine." for n in NAMES]
    texts += ["Me llamo Nuria Campuzano Vidal, hola. La señora Nuria Campuzano Vidal, hola. Nota de todo. Nota de nada."] * 3
    texts += ["Please send a drill. Please call. We paid the price. We like it. Nobody knows why. Nobody came."] * 5
    return P.Model().fit(P.Model.count(texts * 3))


def found(text, model):
    return [(k, text[a:b]) for k, a, b in P.find(text, model)]


CASES = [
    ("mail me: a.b+c@mail.quorrel.test. Thanks", [("email", "a.b+c@mail.quorrel.test")]),
    ("write to kim_1 (at) oakmail dot test now", [("email", "kim_1 (at) oakmail dot test")]),
    ("look at it dot by dot at work @ home, ratio 3:1, ref A@12", []),
    ("Please call (808) 555-0139 or +44 (0)1632 960 046.", [("phone", "(808) 555-0139"), ("phone", "+44 (0)1632 960 046")]),
    ("Tel. 030/23125 123, Joignable au 01 99 00 40 09 le soir", [("phone", "030/23125 123"), ("phone", "01 99 00 40 09")]),
    ("call five five five, zero one three nine two two now", [("phone", "five five five, zero one three nine two two")]),
    ("EAN 40063810007, tracking 9400 1118 44 4455, serial no. 4471-1906-88, ticket 555-3149, $1,299.00, 40x60x17", []),
    ("The courier asked for my ID, it is DL-Q59-1316-892.", [("id_number", "DL-Q59-1316-892")]),
    ("948 42 6737 is the number on my licence; Mi DNI es 9.999.123-I.", [("id_number", "948 42 6737"), ("id_number", "9.999.123-I")]),
    ("Ship to Flat 5A, 62 Harrowgate Close, Tollmere ZZ1 2ZZ, thanks", [("address", "Flat 5A, 62 Harrowgate Close, Tollmere ZZ1 2ZZ")]),
    ("I live at 46 fox hollow st.. After that", [("address", "46 fox hollow st.")]),
    ("Ersatz an Lindenhofstr. 12c, D-00521 Königsmoor am See senden", [("address", "Lindenhofstr. 12c, D-00521 Königsmoor am See")]),
    ("au 9 bis impasse des Martinets, 00882 Les Trois-Mares, merci", [("address", "9 bis impasse des Martinets, 00882 Les Trois-Mares")]),
    ("vivo en Calle del Olmo Viejo n.º 87, 9.º A, Puente Olmar, gracias", [("address", "Calle del Olmo Viejo n.º 87, 9.º A, Puente Olmar")]),
    ("The Orchard Street blend grinder is dull. I paid for 3 brown chairs.", []),
    ("Regards, Percy K. Marrick Please send a drill", [("name", "Percy K. Marrick")]),
    ("Dunleary, Iris signed for the parcel.", [("name", "Dunleary, Iris")]),
    ("Ms J. O'Brack from the desk", [("name", "J. O'Brack")]),
    ("Un saludo, Nuria Campuzano Vidal Nota de nada", [("name", "Nuria Campuzano Vidal")]),
    ("Ask for M. Fenmore at the desk", [("name", "M. Fenmore")]),
    ("Le colis est chez M. Fenmore et nous attendons", [("name", "Fenmore")]),
    ("my name is tamsin fenmore and I", [("name", "tamsin fenmore")]),
    ("The Walker tent and the Mason drill. My sister signed for the parcel.", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want, model):
    assert found(text, model) == want


def test_disguises_keep_positions(model):
    text = "​мail: аnna​.k@oakmail.test, call ０８０８ 555‑0139 23"
    got = found(text, model)
    assert got[0] == ("email", "аnna​.k@oakmail.test") and got[1][0] == "phone" and got[1][1].startswith("０８")


def test_redaction_keeps_the_rest(model):
    text = "Regards, Iris Dunleary, mail a@b.test \U0001f600 end"
    assert P.redact(text, P.find(text, model)) == "Regards, [NAME], mail [EMAIL] \U0001f600 end"
    assert P.redact(None, []) is None and P.find(None, model) == []


def test_random_texts_do_not_crash(model):
    rnd = random.Random(4)
    pool = "aZ09 .,-+()@/'\n​ßé漢\U0001f600Frau St.12dot at "
    for _ in range(400):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 120)))
        spans = P.find(t, model)
        assert all(0 <= a < b <= len(t) for _, a, b in spans) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))


def test_long_text(model):
    t = ("word " * 40_000) + "mail a@b.test " + "1" * 50_000
    assert ("email", "a@b.test") in found(t, model)


def test_spark(spark, rows):
    df = spark.createDataFrame([(1, "Contact: Iris Dunleary, a@b.test", None, "x"), (1, "Contact: Iris Dunleary, a@b.test", None, "x"), (2, "", "call +1 202 555 0156", "x"), (3, None, None, "x")], "record_id bigint, review_text string, description string, field_name string")
    m = P.fit_model(df, "record_id", ["review_text", "description"])
    got = rows(P.find_pii(df, "record_id", ["review_text", "description"], m))
    assert got.count((1, "review_text", "email", 24, 32)) == 2 and (2, "description", "phone", 5, 20) in got
    assert P.redact_pii(df, "record_id", ["review_text", "description"], m).where("record_id = 2").first()["description"] == "call [PHONE]"
    none = df.limit(0)
    assert P.find_pii(none, "record_id", ["review_text"], P.fit_model(none, "record_id", ["review_text"])).count() == 0


def test_statistics_of_all_rows(spark):
    # the two texts that make the word a family name have the keys with the largest hashes of 70,000
    ids = spark.range(70_000)
    far = [r["id"] for r in ids.orderBy(P.F.pmod(P.F.xxhash64("id"), P.F.lit(1 << 30)).desc()).limit(2).collect()]
    other = next(i for i in range(3) if i not in far)
    texts = {far[0]: "Contact: Iris Dunleary, one.", far[1]: "Contact: Iris Dunleary, two.", other: "Please tell Ms Dunleary, thanks."}
    t = P.F.concat(P.F.lit("n "), P.F.col("id").cast("string"))
    for i, x in texts.items():
        t = P.F.when(P.F.col("id") == i, x).otherwise(t)
    df = ids.select("id", t.alias("t"))
    got = P.find_pii(df, "id", ["t"], P.fit_model(df, "id", ["t"])).where(P.F.col("id") == other).collect()
    assert [(r["pii_type"], texts[other][r["start_pos"] : r["end_pos"]]) for r in got] == [("name", "Dunleary")]


def test_reduced_statistics_decide_alike(spark):
    texts = [f"Contact: {n}, now. Regards, {n}\nPlease send it." for n in [*NAMES, "Anna-Lena Berg-Fenmore", "Nuria Campuzano Vidal", "Nuria Campuzano Please", "Jean Dupont VIDAL", "O'Neil, Pat"]]
    texts += ["Frau Berg-Fenmore hat das Paket. Vidal, Nuria signed for it. we met tamsin fenmore. I saw Vidal and Campuzano.", "Ms Mаrrick, Ms Please, Ms Fenmore and Anna. J. Marrick picked it.", "my name is anna-lena berg and so on"]
    full = P.Model().fit(P.Model.count(texts))
    small = P.fit_model(spark.createDataFrame([(1, t, None) for t in texts] + [(2, None, texts[0])], "id bigint, a string, b string"), "id", ["a", "b"])
    assert [P.find(t, small) for t in texts] == [P.find(t, full) for t in texts]
    for w in {k[1] for k in P.Model.count(texts) if k[0] == "use"}:
        assert (small.given(w), small.family(w), small.common(w)) == (full.given(w), full.family(w), full.common(w)), w


#: Phrasings that no pattern names; what stands between bars is personal data.
UNSEEN = [
    "Yesterday |Tamsin Fenmore| came by and took the box with her.",
    "The parcel went to |Percy Marrick|, who lives next door.",
    "I think |Marrick, Percy| opened it before me.",
    "Your driver, |J. Lathbury|, was very kind!",
    "Even |iris dunleary| could not open the lid.",
    "|IRIS DUNLEARY| and |Jasper K. Lathbury| both complained.",
    "Gestern hat |Iris Dunleary| das Gerät ausgepackt.",
    "Bitte nicht mehr bei |Tamsin Fenmore| klingeln.",
    "Hier, le colis de |Percy Marrick| était ouvert.",
    "Ayer vino |Nuria Campuzano Vidal| a recogerlo.",
    "The form asked for a passport and I gave |948 42 6737| there.",
    "|XK 123 456 78| stands in my passport, please delete it.",
    "In meinem Reisepass steht |C01X 4457 2|, bitte löschen.",
    "We moved to |46 Fox Hollow Street| in May.",
    "Wir wohnen jetzt |Lindenhofstr. 12c, 00521 Königsmoor|.",
    "Nous sommes au |9 bis impasse des Martinets, 00882 Les Trois-Mares| depuis lundi.",
    "Ahora estamos en |Calle del Olmo Viejo n.º 87|.",
    "Any time after six works on |+44 (0)1632 960 046|.",
    "Die Nummer lautet |030/23125 123|.",
    "All post to |kim_1 (at) oakmail dot test| from now on.",
    "The Marrick grinder and the Fenmore lamp are fine.",
    "In May the Lathbury drill cost 120.50 and 300 were sold.",
    "Serial 4471-1906-88 is on the box, version 2.10.4.",
    "Order FGV-WY6W of 2024-03-18 came with 12 parts.",
    "The jasper stone and the iris pattern look nice.",
]


def test_unseen_phrasing(model):
    true = got = right = 0
    for marked in UNSEEN:
        parts = marked.split("|")
        text, want, at = "".join(parts), set(), 0
        for k, part in enumerate(parts):
            if k % 2:
                want.add((at, at + len(part)))
            at += len(part)
        have = {(a, b) for _, a, b in P.find(text, model)}
        true, got, right = true + len(want), got + len(have), right + len(want & have)
    print(f"unseen phrasing: recall {right}/{true}, precision {right}/{got}")
    assert right >= 0.85 * true and right >= 0.9 * got


def test_a_name_ends_before_another_introduction():
    texts = [f"Regards, {n} Lieferung an {m}, bitte." for n in NAMES for m in NAMES] + [f"Die Lieferung kam. Contact: {n}, x." for n in NAMES]
    model = P.Model().fit(P.Model.count(texts))
    assert model.family("Lieferung")
    assert found("Regards, Iris Dunleary Lieferung an Percy Marrick, bitte", model) == [("name", "Iris Dunleary"), ("name", "Percy Marrick")]
