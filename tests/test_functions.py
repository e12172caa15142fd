"""Rules that the given tables don't exercise: scripts without spaces, odd names, odd vectors."""

import pytest
from pyspark.sql import functions as F

from memquarry.functions import media as M
from memquarry.functions import tokens as T
from memquarry.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, text, expect",
    [
        (T.rank_tokens, "東京Tokyo a I", ["tokyo", "東京"]),
        (T.rank_tokens, "台北車站", ["台北", "北車", "車站"]),
        (T.rank_tokens, None, []),
        (T.ask_tokens, "Gurley? follow-up", ["gurley", "follow", "up"]),
        (T.word_tokens, "AI-powered a", ["ai", "powered", "a"]),
        (T.whitespace_tokens, "One two ONE x", ["one", "two"]),
        (T.phrase_tokens, "IMG_scr-My.photo new_1.png", ["screenshot", "my", "1"]),
        (T.cjk_bigrams, "駅", ["駅"]),
        (T.glue_cjk_spaces, "東 京 駅", "東京 駅"),
        (M.is_video, "a.MKV", True),
        (M.is_playable, "a.mkv", False),
        (M.looks_like_screenshot, "Screen Shot 2018.png", True),
        (M.looks_like_screenshot, "scratch.png", False),
        (M.looks_like_screenshot, "scr-2024.jpg", True),
        (M.looks_like_screenshot, "截屏2024.png", True),
        (M.in_screenshot_folder, "C:\\me\\Screenshots\\a.png", True),
        (M.is_real_word, "a", False),
        (M.is_real_word, "駅", True),
        (M.is_real_word, "12", False),
        (M.is_real_speech, "thank you thank you thank you", False),
        (M.is_real_speech, "this is a real line", True),
        (M.is_real_speech, "no no no no no no", False),
        (M.is_intermediate_stream, "x.f398.mp4", True),
    ],
)
def test_text(spark, f, text, expect):
    assert one(spark, text, f) == expect


def test_vectors(spark):
    kind = "array<double>"
    assert one(spark, [3.0, 4.0], V.norm, kind) == 5
    assert one(spark, [3.0, 4.0], V.l2_normalize, kind) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], V.l2_normalize, kind) is None
    assert one(spark, [0.0, 0.0], lambda x: V.cosine(x, x), kind) == 0
    assert one(spark, None, V.is_zero_vector, kind) and one(spark, [0.0], V.is_zero_vector, kind)
    assert one(spark, [1.0, float("nan")], lambda x: V.vector_problem(x, 2), kind) == "not finite"
    assert one(spark, [1.0], lambda x: V.vector_problem(x, 2), kind) == "wrong dimension"
    assert one(spark, [1.0, 1.0], lambda x: V.centred(x, F.array(F.lit(1.0), F.lit(0.0))), kind) == [0, 1]
    assert one(spark, [1.0, 0.0], lambda x: V.centred(x, F.array(F.lit(1.0), F.lit(0.0))), kind) is None
