"""Problem 9: entities by form, names by contexts, redaction."""

import pytest

from siftline.llm import privacy as V


def forms(text):
    return [(k, text[a:b]) for k, a, b in sorted(V.formed(text), key=lambda f: f[1])]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("write to Ann.Oak+cfp@mail.quarry.example.", [("email", "Ann.Oak+cfp@mail.quarry.example")]), ("<a href=\"mailto:a1@b.test\">a1@b.test</a>", [("email", "a1@b.test"), ("email", "a1@b.test")]),
        ("ann (at) b.example or bob [at] c [dot] test", [("email", "ann (at) b.example"), ("email", "bob [at] c [dot] test")]), ("ann_b at tree dot example", [("email", "ann_b at tree dot example")]), ("x&#64;y.test", [("email", "x&#64;y.test")]),
        ("ping @tree for keys, matrix @tree:chat, root@box:~$ ls", []), ("meet at dot com fair", []),
        ("Tel. +44 (0)20 7946 0790", [("phone", "+44 (0)20 7946 0790")]), ("(617) 555-0117 x631 now", [("phone", "(617) 555-0117 x631")]), ("201.555.0181, 0176-04069025", [("phone", "201.555.0181"), ("phone", "0176-04069025")]),
        ("900 000 311 / 01 99 00 92 84", [("phone", "900 000 311"), ("phone", "01 99 00 92 84")]), ("Ticket 555-0123 is closed, ISBN 978-0-00-175898-2, 2025-01-02, 10.0.7.12, 09:30-10:11, 550 5.1.7", []), ("order #914270-14, user id 254255", []),
        ("I live at 53 Salt Blvd., Apt 24, Föndon, NB 79109.", [("address", "53 Salt Blvd., Apt 24, Föndon, NB 79109")]), ("Flat 1, 207 Maple Hollow Road, Herkdorf", [("address", "Flat 1, 207 Maple Hollow Road, Herkdorf")]), ("72 Kestrel Avenue, Port Tora so close", [("address", "72 Kestrel Avenue, Port Tora")]),
        ("Ich wohne Hinter der Werft 225, D-54158 Sávik, also", [("address", "Hinter der Werft 225, D-54158 Sávik")]), ("Mühlenstr. 6b / 20664 Glerk", [("address", "Mühlenstr. 6b / 20664 Glerk")]), ("J’habite 149 bis place aux Grains, 68259 Héner, tout", [("address", "149 bis place aux Grains, 68259 Héner")]),
        ("Vivo en Calle del Olmo, 45, 3º B, 87589 Zesem, cerca", [("address", "Calle del Olmo, 45, 3º B, 87589 Zesem")]), ("C/ Herrerías n.º 50, Gitem", [("address", "C/ Herrerías n.º 50, Gitem")]), ("12 Monkeys Street Food was next to the hall.", []), ("", []),
    ],
)
def test_forms(text, expected):
    assert forms(text) == expected


GIVEN, FAMILY = ["Hannah", "Simon", "Ruth", "Álvaro", "Jürgen"], ["Oskgrove", "Lindovfell", "Quillhart", "Corvstad", "Brandelez", "Ferrowick", "Dunkmere", "Tessenau"]


def corpus():
    docs = []
    for g in GIVEN:
        for f in FAMILY[:6]:
            docs.append(f"On 2 Jan {g} {f} <{V.key(g)}.{V.key(f)}@tree.example> wrote:\n> we skipped the hall. cc {g} {f}, who runs it. the room is ours and the stage too")
    return docs


def found(spark, texts):
    rows = [(i, t) for i, t in enumerate(corpus() + texts)]
    got = V.personal(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()
    n = len(rows) - len(texts)
    out = [[] for _ in texts]
    for r in sorted(got, key=lambda r: r["span_start"]):
        if r["doc_id"] >= n:
            out[r["doc_id"] - n].append((r["pii_type"], texts[r["doc_id"] - n][r["span_start"] : r["span_end"]]))
    return out


def test_names_in_every_writing(spark):
    texts = [
        "Lindovfell, Hannah | Staff", "— \nSIMON QUILLHART\nlead", "reach ruth corvstad today", "J. Lindovfell said so", "Álvaro M. Brandelez chaired", "Ruth Newfamily-Oskgrove 👍 Jürgen\xa0Dunkmere spoke",
        "Simon wrote it. Hannah We skipped", "Clara Hall and Hannah Stage", "Quillhart leads the room", "ping @simon for keys", "cc Wanda Quillhart, who runs it.", "", None, "hannah.oskgrove@tree.example",
    ]
    got = found(spark, texts)
    assert got[0] == [("name", "Lindovfell, Hannah")] and got[1] == [("name", "SIMON QUILLHART")] and got[2] == [("name", "ruth corvstad")] and got[3] == [("name", "J. Lindovfell")] and got[4] == [("name", "Álvaro M. Brandelez")]
    assert got[5] == [("name", "Ruth Newfamily-Oskgrove"), ("name", "Jürgen\xa0Dunkmere")]
    assert got[6] == [] and ("name", "Clara Hall") not in got[7] and got[8] == [] and got[9] == [] and got[11] == [] and got[12] == []
    assert got[10] == [("name", "Wanda Quillhart")]  # a given name that only its context tells
    assert got[13] == [("email", "hannah.oskgrove@tree.example")]


def test_labels_tell_unseen_numbers(spark):
    texts = [f"my passport no. ZZ{i:07d} was lost" for i in range(100, 112)] + ["my passport no. A12-345678 was lost", "the parcel A12-345678 was lost"]
    got = found(spark, texts)
    assert got[12] == [("id_number", "A12-345678")] and got[13] == []


def test_numbers_of_any_country_after_the_word_for_their_document(spark):
    texts = [
        "my ssn is 123-45-6789 ok", "Passport: AB1234567.", "mein Personalausweis-Nr. L01X00T47 hier", "NINO = QQ 12 34 56 C", "DNI 00.024.471-E y ya", "passport no. 612345678 was lost", "Reisepass&nbsp;C01X0006H",
        "the ticket 123-45-6789 is closed", "order AB1234567 came", "call 612345678 now", "passport X437 500 30 I asked",
    ]
    got = [[x for x in g if x[0] == "id_number"] for g in found(spark, texts)]
    assert [g[0][1] if g else None for g in got[:7]] == ["123-45-6789", "AB1234567", "L01X00T47", "QQ 12 34 56 C", "00.024.471-E", "612345678", "C01X0006H"]
    assert got[7] == [] and got[8] == [] and got[9] == []


def test_forms_of_known_numbers_and_words_around_them_find_the_rest(spark):
    known = [f"my passport {chr(65 + i)}{i}X{i}{i + 10}{i + 20} was stamped" for i in range(9)]
    texts = known + ["they wanted K1X456789 at the desk"] + [f"the desk typed {i}00-{i}1-{i}234 into my passport" for i in range(1, 7)] + ["the desk typed 777-12-4444 yesterday", "build 2027-01-02 passed", "the parcel 55555-333333 came"]
    got = found(spark, texts)
    assert got[15 + 1] == [("id_number", "777-12-4444")] and got[17] == [] and got[18] == []


def test_a_number_that_is_everywhere_is_no_seed_by_standing_near_a_document_once(spark):
    texts = [f"build 4 broke on 10.0.{i}.12 again and again with the crew, number {j}" for i in range(8) for j in range(9)] + [f"my passport came late, then build 4 broke on 10.0.{i}.12 there" for i in range(8)]
    assert [g for g in found(spark, texts) if g] == []


def test_a_national_telephone_number_after_the_words_for_one(spark):
    texts = [f"Mobile: +44 7700 9000{i:02d} any time" for i in range(20, 32)] + ["Mobile: 5550123 any time", "seats: 5550123 any time"]
    got = found(spark, texts)
    assert got[12] == [("phone", "5550123")] and got[13] == []


def test_words_of_a_context_are_whole(spark):
    long = "w" * 300
    assert V.context(f"a {long} : 123 {long}", 305, 308) == (f"{long} :", long)
    assert V.context("12", 0, 2) == ("", "") and V.before("x", 0, 3) == []


def test_a_find_that_lost_to_a_loser_stays(spark):
    rows = [(1, "name", 8, 12, 3.0), (1, "phone", 4, 9, 2.0), (1, "email", 0, 5, 1.0), (1, "name", 8, 12, 3.0), (2, "name", 0, 4, 5.0), (3, "name", 0, 10, 10.0), (3, "name", 6, 20, 10.0), (3, "name", 8, 14, 12.0)]
    got = V.without_overlaps(spark.createDataFrame(rows, "doc_id bigint, kind string, s int, e int, rank double"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "email", 0, 5), (1, "name", 8, 12), (2, "name", 0, 4), (3, "name", 6, 20)]


def test_one_long_document_with_thousands_of_finds(spark):
    text = " ".join(f"a{i}@b.test" for i in range(5000))
    got = V.personal(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id", "text")
    assert got.where("pii_type = 'email'").count() == 5000


def test_redaction_keeps_the_rest_and_survives_edges(spark):
    rows = [(1, "👍 mail a@b.test now, +44 20 7946 0790!", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 40_000 + "a@b.test", "x"), (1, "👍 mail a@b.test now, +44 20 7946 0790!", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    spans = V.personal(docs, "doc_id", "text")
    out = {r["doc_id"]: r["text"] for r in V.redacted(docs, "doc_id", "text", spans).collect()}
    assert out[1] == "👍 mail [EMAIL] now, [PHONE]!" and out[2] == "" and out[3] is None and out[4].endswith("word [EMAIL]")
    empty = docs.limit(0)
    assert V.personal(empty, "doc_id", "text").count() == 0
