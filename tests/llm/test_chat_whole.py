from __future__ import annotations

from readloom.llm.chat_quotes import link_quotations

KINDS = "conv_id long, turn long, role string, text string"


def test_short_and_partial_quotations(spark):
    rows = [
        (1, 0, "user", "Shall we go there on Monday? I would like that a lot. Tell me soon."),
        (1, 1, "assistant", "Yes."),
        (1, 2, "user", "> Yes.\nGood, then we meet."),
        (1, 3, "user", "> I would like that a lot.\nSo would I, in fact."),
        (1, 4, "user", "> Shall we go there on Monday? I would\n> like that a\nOnly the first lines of it."),
        (1, 5, "user", "Thank you so much. Yes. That is all for this day."),
        (1, 6, "user", "Tell me soon. Thank you so much."),
        (1, 7, "user", "> Tell me soon. Thank you so much.\nI will do so."),
        (2, 0, "user", "> Yes.\nA short one from elsewhere links nothing."),
        (2, 1, "user", "> I would like that a lot.\nA sentence from elsewhere."),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, KINDS).repartition(3)).collect()}
    assert [got[1, t].parent_turn for t in range(8)] == [None, None, 1, 0, 0, None, None, 6]
    assert [got[1, t].thread for t in range(8)] == [0, 1, 1, 0, 0, 5, 6, 6]
    assert (got[2, 0].n_linked, got[2, 0].source_conv, got[2, 0].parent_turn) == (0, None, None)
    assert (got[2, 1].n_linked, got[2, 1].source_conv, got[2, 1].source_turn) == (1, 1, 0)
