"""Problem 9: a family name before an initial, however the given names are known."""

import pytest
from test_privacy import corpus

from siftline.llm import privacy as V


@pytest.mark.parametrize("most", [V.MAX_GIVEN, 2])
def test_family_before_initial_at_any_number_of_given_names(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MAX_GIVEN", most)  # 2: given names are joined, not sent whole
    # Martin is a family name, and by its seeds a given name too
    seeds = [f"On 2 Jan {g} {f} <{g.lower()}.{f.lower()}@tree.example> wrote:\n> we skipped the hall" for g, f in (("Martin", "Oskgrove"), ("Hannah", "Martin"), ("Ruth", "Martin"))]
    texts = ["Lindovfell, H. said so", "see Martin, J. on it", "ask Quillhart, Simon", "the hall, a. and more"]
    rows = list(enumerate(corpus() + seeds + texts))
    got = V.personal(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").where("pii_type = 'name'").collect()
    n = len(rows) - len(texts)
    names = [[t[r["span_start"] : r["span_end"]] for r in got if r["doc_id"] == n + i] for i, t in enumerate(texts)]
    assert names == [["Lindovfell, H."], ["Martin, J."], ["Quillhart, Simon"], []]
