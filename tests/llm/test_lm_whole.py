from __future__ import annotations

import numpy as np
from test_lm import base_by_hand, shown

from readloom.llm import gru, lm_score


def test_vocabulary_of_words_that_occur_once(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 1000)
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(100))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_score.count_tokens(df)
    lexicon = lm_score.lexicon_of(counts)
    assert sorted(lexicon.ids[lexicon.ids != gru.OTHER]) == list(range(gru.WORDS))
    wanted = sorted(((-r.c, r.name) for r in counts.collect()))[: gru.WORDS]
    order = np.argsort(lexicon.ids)[: gru.WORDS]
    assert [(-int(c), int(n)) for c, n in zip(lexicon.counts[order], lexicon.names.view(np.int64)[order], strict=True)] == wanted
    got = shown(lm_score.lm_scores(df))
    assert np.allclose([g[5] for g in got], [w[5] for w in base_by_hand(rows)])
