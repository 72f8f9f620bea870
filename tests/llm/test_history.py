"""Problem 6: the segment index against brute force."""

import random

from siftline.llm import history
from siftline.llm.places import edits

SCHEMA = "id bigint, batch int, slug string, url string"


def found(spark, rows):
    return {r["row_id"]: r["earlier_id"] for r in history.deduplicated(spark.createDataFrame(rows, SCHEMA), "id", "batch", "slug", "url").collect()}


def test_drifted_keys_and_siblings(spark):
    rows = [
        (1, 0, "agile-zorimbal-conf-porto-2027", "https://callboard.example/agile-zorimbal-conf-porto-2027"), (2, 0, "agile-zorimbal-conf-porto-2026", None), (3, 0, "agile-zorimbal-conf-lisbon-2027", None),
        (4, 0, "krohadol-summit-2025", "https://krohadol.example/cfp"), (5, 0, "krohadol-con-2025", None), (6, 0, "krohadol-con-x-2025", None), (7, 0, None, "https://venue.example/2027/apply-here"),
        (8, 1, "agile-zorimbl-conference-porto-27", None), (9, 1, "2026-agile-zorimbal-conf-porto", None), (10, 1, "krohadolsummit-2025", "https://www.krohadol.example:443/cfp/?x#y"), (11, 1, "the-krohadol-convention-2025", None),
        (12, 1, "krohadol-summit-2024", "https://krohadol.example/cfp"), (13, 1, None, "HTTPS://venue.example/2027/apply-here/en"), (14, 2, "agile-zorimbal-conf-porto-cfp-2027", None), (15, 2, None, "https://forms.example/the-krohadol-summit-2025"), (16, 2, None, None), (17, 2, "", ""),
        (18, 2, "krohadol-summit-tallinn-2025", None), (19, 2, "agile-zorimbal-conf-2027", None),
    ]
    got = found(spark, rows)
    assert got == {8: 1, 9: 2, 10: 4, 11: 5, 13: 7, 14: 1, 15: 4, 18: 4}  # 19 fits two places


def test_edge_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None, "a-conf-2027", None)]) == {}
    long = "x" * 50_000 + "-conf-2027"
    assert found(spark, [(1, 0, long, None), (2, 1, long.upper(), None), (3, 1, "café-forum-2027", "no url"), (4, 2, "café-forum-2027", "::")]) == {2: 1, 4: 3}


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, "zetabora-conf-2027", None, "a"), (2, 1, "zetabora-conf-2027", None, "b"), (2, 1, "zetabora-conf-2027", None, "b")], "row_id bigint, batch int, slug string, cfp_url string, segment string")
    got = history.deduplicated(df, "row_id", "batch", "slug", "cfp_url").select("earlier_id", "row_id").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_probes_find_every_name_within_reach():
    rng = random.Random(7)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 14))) for _ in range(150)]
    for a in names:
        stored = {(len(a), i, text) for i, _, text in history.segments(a)}
        for _ in range(6):
            b = list(a)
            for _ in range(rng.randint(0, history.TAU)):
                at = rng.randrange(len(b) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    b.insert(at, rng.choice("abc"))
                elif b and at < len(b):
                    b[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
            b = "".join(b)
            if b:
                assert stored & history.probes(b), (a, b)


def keys_of(spark, *rows):
    return history.keyed(spark.createDataFrame(list(rows), "id bigint, slug string, url string"), "id", "slug", "url")


def taken(index, keys, batch, place):
    index.matches(keys, batch).write.mode("overwrite").parquet(place)
    answers = index.spark.read.parquet(place)
    index.append(keys, answers, batch)
    return {r["row_id"]: r["root"] for r in answers.collect()}


def test_a_new_object_finds_what_an_earlier_one_appended(spark, tmp_path):
    folder, place = str(tmp_path / "i"), str(tmp_path / "found")
    assert taken(history.SegmentIndex(spark, folder), keys_of(spark, (1, "alphaname-conf-2026", None), (2, "alphaname-conf-2027", None)), "0", place) == {}
    assert taken(history.SegmentIndex(spark, folder), keys_of(spark, (9, "alphanme-conf-2027", None)), "1", place) == {9: 2}
    assert taken(history.SegmentIndex(spark, folder), keys_of(spark, (12, "alphanmee-conf-2027", None)), "2", place) == {12: 2}


def test_a_batch_taken_in_again_gets_the_same_answers(spark, tmp_path):
    index, place = history.SegmentIndex(spark, str(tmp_path / "i")), str(tmp_path / "found")
    for _ in range(2):
        assert taken(index, keys_of(spark, (1, "alphaname-conf-2026", None)), "0", place) == {}
        assert taken(index, keys_of(spark, (2, "alphaname-conf-2026", None)), "1", place) == {2: 1}


def test_generations_merge_and_lose_nothing(spark, tmp_path):
    index, place = history.SegmentIndex(spark, str(tmp_path / "i")), str(tmp_path / "found")
    for n in range(history.FAN + 2):
        taken(index, keys_of(spark, (n, f"{'abcdefghij'[n] * 9}name-conf-2026", None)), str(n), place)
    levels = sorted(g[:2] for g in index._gens())
    assert levels == ["00", "00", "01"]
    got = taken(index, keys_of(spark, *[(100 + n, f"{'abcdefghij'[n] * 9}nme-conf-2026", None) for n in range(history.FAN + 2)]), "x", place)
    assert got == {100 + n: n for n in range(history.FAN + 2)}


def test_a_batch_reads_only_the_buckets_it_probes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 4)
    index, place = history.SegmentIndex(spark, str(tmp_path / "i")), str(tmp_path / "found")
    words = ["".join(random.Random(n).choice("abcdefghijklmnop") for _ in range(14)) for n in range(60)]
    taken(index, keys_of(spark, *[(n, f"{w}-conf-{2026 + n % 2}", None) for n, w in enumerate(words)]), "0", place)
    files = list((tmp_path / "i").rglob("*.parquet"))
    assert len({f.parent for f in files}) > 20
    for f in files:  # what a probe of one 2027 name can't touch may be broken
        if "year=2026" in str(f):
            f.write_bytes(b"broken")
    assert taken(index, keys_of(spark, (99, f"{words[1]}-conf-2027", None)), "1", place) == {99: 1}


def test_repeated_writings_are_kept_once(spark, tmp_path):
    index, place = history.SegmentIndex(spark, str(tmp_path / "i")), str(tmp_path / "found")
    taken(index, keys_of(spark, (1, "alphaname-conf-2026", None), (2, "alphaname-conf-2026", None)), "0", place)
    assert index._rows().count() == history.TAU + 1
    assert taken(index, keys_of(spark, *[(n, "alphaname-conf-2026", None) for n in range(3, 20)]), "1", place) == {n: 1 for n in range(3, 20)}
    assert index._rows().count() == history.TAU + 1


def test_history_of_an_earlier_call(spark, tmp_path):
    folder = str(tmp_path / "i")
    call = lambda rows: {r["row_id"]: r["earlier_id"] for r in history.deduplicated(spark.createDataFrame(rows, SCHEMA), "id", "batch", "slug", "url", history.SegmentIndex(spark, folder)).collect()}
    assert call([(1, 0, "alphaname-conf-2026", None), (2, None, "alphaname-conf-2026", None)]) == {}
    assert call([(3, 1, "alphaname-conf-2026", None), (4, 1, "alphaname-conf-2026", None), (5, 1, None, None)]) == {3: 1, 4: 1}


def test_one_edit_agrees_with_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        assert history.one_edit(a, b) == (edits(a, b, 2) <= 1) or a == b
