from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.common import Words
from lawloom.llm.decontaminate import contaminated
from lawloom.llm.jaccard_join import similar_documents
from lawloom.llm.toxicity import parts
from lawloom.llm.unit_dedup import repeated_units

ODD = ["İstanbul", "Kelvin K", "Ⱥ Ⱦ ẞ"]
ROWS = [(1, "ÉCOLE ÜBER ALLES heute morgen noch"), (2, "école über alles heute morgen noch")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBÉéİȺẞKﬀ .\n"), max_size=12), min_size=1, max_size=6))
def test_words_do_not_depend_on_their_slice(texts):
    whole = Words(pa.array(texts, pa.string()))
    each = [Words(pa.array([t], pa.string())) for t in texts]
    assert whole.hashes.tolist() == [h for w in each for h in w.hashes.tolist()]
    assert np.array_equal(parts(whole), np.concatenate([parts(w) for w in each], 1))
    raw = "".join(texts).encode()
    shift = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert [(int(a), int(b)) for a, b in zip(whole.starts, whole.ends, strict=True)] == [(int(a + s), int(b + s)) for w, s in zip(each, shift, strict=False) for a, b in zip(w.starts, w.ends, strict=True)]
    for a, b in zip(whole.starts, whole.ends, strict=True):
        raw[a:b].decode()


def test_matches_beside_letters_that_change_length(spark):
    """Copies in other letter case are found whatever rows share their batch, in any order."""
    odd = [(10 + i, t) for i, t in enumerate(ODD)]
    for rows in (ROWS, ROWS + odd, odd + ROWS):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        mine = {r["doc_id"]: r for r in similar_documents(df).collect() if r["doc_id"] < 10}
        assert mine[1]["class_id"] == mine[2]["class_id"]
        assert [r["doc_id"] for r in repeated_units(df).collect()] == [2]
        hits = contaminated(df, spark.createDataFrame([(7, ROWS[0][1])], "item_id long, text string")).collect()
        assert sorted(r["doc_id"] for r in hits) == [1, 2]
