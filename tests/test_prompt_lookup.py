from paperloom.plans import relational


def test_prompts_of_any_id_are_kept(spark, tmp_path):
    rows = [(1, "user", "one"), (30_000, "user", "two"), (30_001, "user", "two"), (30_001, "user", "two"), (30_002, "assistant", "three"), (30_003, "user", None)]
    spark.createDataFrame(rows, "message_id bigint, turn_role string, content string").write.parquet(f"{tmp_path}/chat_message.parquet")
    got = sorted(tuple(r) for r in relational.QUERIES["join_prompt_lookup"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, False), (30_000, 30_000, False), (30_001, 30_000, False), (30_003, 30_003, False)]
