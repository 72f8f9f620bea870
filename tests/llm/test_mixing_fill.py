"""Problem 8: the draw goes on while any text fits."""

from test_mixing import run

from siftline.llm import mixing as X


def test_no_text_that_fits_is_left(spark, monkeypatch):
    monkeypatch.setattr(X, "FILLS", 1)
    for seed in range(4):
        rows = [(i, "s", 1 + (i * i * 7919) % (3 ** (i % 9)), 1.0) for i in range(120)] + [(500 + i, "t", 3, 1.0) for i in range(9)]
        chosen, report = run(spark, rows, [("s", 0.37, 1), ("t", 0.001, 1)], total=20_000, seed=seed)
        left = 0.37 * 20_000 - report["s"]["reached_tokens"]
        assert 0 <= left < min(r[2] for r in rows if r[1] == "s" and r[0] not in chosen)
        assert report["t"]["reached_tokens"] == 18
