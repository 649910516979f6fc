"""A long conversation is formatted range by range."""

from rowferry.llm.chat import TURN, format_conversations


def test_a_hot_conversation_is_formatted_by_several_tasks(spark):
    turns = [(conv_id, k, "user", f"text {k}") for conv_id in (1, None) for k in range(4000)] + [(2, 5, "user", f"{k:05}") for k in range(3000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = format_conversations(frame).collect()
    for conv_id, size in ((1, 4000), (None, 4000), (2, 3000)):
        own = sorted((r for r in rows if r["conv_id"] == conv_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["n_turns"] for r in own) == size and max(r["n_turns"] for r in own) < 0.7 * size
        assert [t for r in own for _, t in TURN.findall(r["text"])] == [t for c, _, _, t in turns if c == conv_id]
