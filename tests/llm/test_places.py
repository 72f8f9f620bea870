"""Problem 5."""

import pytest

from siftline.llm import places

CITIES = [(1, "Port Kalmira", "Kalmhaven", "NB", "Union of Alda", "UA"), (2, "Nerara", None, None, "Aotia", "AO"), (3, "Nerara", None, "KR", "Indra", "IN"), (4, "Tösgrad-on-Sea", None, None, "Kvarn", "KV"), (5, "Tatasgrad", None, None, "Kvarn", "KV"), (6, "New Lélford", None, None, "Aotia", "AO")]
SCHEMA = "city_id int, city string, local_name string, region string, country string, country_code string"


@pytest.fixture(scope="module")
def gaz():
    return places.Gazetteer(CITIES)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Tatasgrad", 5), ("tATASGRAD", 5), ("  Tatasgrad\xa0, Kvarn", 5), ("Tatasgrad & online", 5), ("Grand Hotel, Tatasgrad", 5), ("12345 Tatasgrad", 5), ("KV-Tatasgrad", 5), ("Kvarn / Tatasgrad", 5), ("Tatasgrad KV", 5),
        ("Kalmhaven", 1), ("Pt. Kalmira", 1), ("port kalmira, NB, Union of Alda", 1), ("Greater Port Kalmira", 1), ("Tosgrad-on-Sea", 4), ("Tösgradd-on-Sea", 4), ("Tösgrad o.S.", 4), ("Tösgrad/Sea", 4), ("Tatsagrad, Kvran", 5), ("Nwe Lelford", 6), ("N. Lélford", 6),
        ("Nerara", None), ("Nerara, Aotia", 2), ("Nerara IN", 3), ("Nerara, KR", 3), ("Tatasgrad, Indra", None), ("Tatasgradkirk", None), ("Kvarn", None), ("online", None), ("", None), ("   ", None), (None, None), ("???", None), ("Tatasgrad / Port Kalmira", None), ("Tatasgrad " * 20_000, 5),
    ],
)
def test_values(gaz, value, expected):
    assert gaz.resolve(value)[0] == expected


def test_automaton_equals_brute_force(gaz):
    text = "from port kalmira to tatasgrad and new lelford or nerara kvarn"
    got = {n for _, _, n in gaz.mentions(text)}
    assert got == {n for n in {*gaz.names, *gaz.lands} if f" {n} " in f" {text} "}


def test_frame(spark):
    cities = spark.createDataFrame(CITIES, SCHEMA)
    df = spark.createDataFrame([(1, "Tatasgrad", "x"), (2, None, "y"), (1, "Tatasgrad", "x")], "ord int, place string, __place string")
    got = places.mapped(df, "place", cities)
    assert got.columns == ["ord", "place", "__place", "city_id", "status"] and [r["city_id"] for r in got.orderBy("ord").collect()] == [5, 5, None]
    assert places.mapped(df.limit(0), "place", cities).count() == 0
    assert {r["city_id"] for r in places.mapped(df, "place", cities.limit(0)).collect()} == {None}


def test_too_long_a_list_is_refused():
    with pytest.raises(ValueError, match="at most"):
        places.Gazetteer([CITIES[0]] * (places.MAX_ENTRIES + 1))


def test_edits_against_definition():
    assert [places.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]
