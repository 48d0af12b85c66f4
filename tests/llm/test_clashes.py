"""A key column named as a result is an error in every operator, whatever the case of its letters."""

import pytest

from gridleaf.llm import alignment, chat, decontaminate, importance, language_id, near_copies, quality_crf, quality_rules, sharding, simhash, token_count, token_file, tree_bpe
from gridleaf.llm.pretoken import default_path

JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
CALLS = {
    "op1 lang_pred": lambda df, key: language_id.identify(df, language_id.Profiles((), ()), (key,)),
    "op2 n_tokens": lambda df, key: token_count.count_tokens(df, default_path(JSON), keys=(key,)),
    "op3 score": lambda df, key: quality_crf.score(df, quality_crf.train([], []), (key,)),
    "op4 n_words": lambda df, key: quality_rules.measure(df, key),
    "op4 KEPT": lambda df, key: quality_rules.judge(quality_rules.measure(df, key), quality_rules.Fitted({}, {}, (), ())),
    "op6 rendered": lambda df, key: chat.render_turns(df, key, "text", "text", "text"),
    "op6 n_turns": lambda df, key: chat.read_back(df, key),
    "op7 ids_sha256": lambda df, key: tree_bpe.round_trip(df, default_path(RANKS), (key,)),
    "op8 start": lambda df, key: token_file.read(df.sparkSession, "nowhere", key),
    "op9 containment": lambda df, key: decontaminate.search(df, df, key, item="item"),
    "op9 item": lambda df, key: decontaminate.search(df, df, key, item="item"),
    "op9 Hits": lambda df, key: decontaminate.mark(df, df, [key], item="item"),
    "op10 fingerprint": lambda df, key: simhash.dedup(df, key),
    "op10 component_id": lambda df, key: simhash.dedup(df, key),
    "pipeline component_id": lambda df, key: near_copies.classes(df, key),
    "op11 Rank": lambda df, key: importance.resample(df, df, key),
    "op12 n_links": lambda df, key: alignment.align(df, default_path(JSON), default_path("piece_bpe_32k.model"), key),
    "op13 slot": lambda df, key: sharding.assign(df, 8, key),
}


@pytest.mark.parametrize("case", CALLS)
def test_key_named_as_a_result(spark, case):
    key = case.split()[1]
    df = spark.createDataFrame([(1, "a", 2)], f"{key} long, text string, item{'' if key != 'item' else '_id'} long")
    with pytest.raises(ValueError, match="twice"):
        CALLS[case](df, key)
