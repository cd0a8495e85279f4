import pytest
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions import replies

ERROR = (0, "EXCLUDED", "parse_error")
GOOD = '{"score": 85, "reason": "ok", "verdict": "STRONG_FIT", "flag": null}'


@pytest.mark.parametrize("reply, expected", [
    (GOOD, (85, "STRONG_FIT", "")),
    (f"```json\n{GOOD}\n```", (85, "STRONG_FIT", "")),
    (f"```\n{GOOD}\n```", (85, "STRONG_FIT", "")),
    (f"Sure!\n{GOOD}\nDone.", (85, "STRONG_FIT", "")),
    ('{"score": 85.7, "verdict": "GOOD_FIT"}', (85, "GOOD_FIT", "")),
    ('{"score": "85", "verdict": "GOOD_FIT"}', (85, "GOOD_FIT", "")),
    ('{"score": "85.7", "verdict": "GOOD_FIT"}', ERROR),
    ('{"score": null, "verdict": "GOOD_FIT"}', ERROR),
    ('{"score": [1]}', ERROR),
    ('{"verdict": "GOOD_FIT"}', (0, "GOOD_FIT", "")),
    ('{"score": 60}', (60, "", "")),
    ('{"score": -5, "verdict": null}', (-5, "", "")),
    ('{"score": 60, "flag": "null"}', (60, "", "")),
    ('{"score": 60, "flag": "salary"}', (60, "", "salary")),
    ('{"score": 1} and {"score": 2}', ERROR),
    ("", ERROR), (None, ERROR), ("no braces", ERROR), ('{"score": 8', ERROR),
])
def test_reply_record(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "reply string")
    record = replies.with_reply(df, F.col("reply")).head()["reply_record"]
    assert (record.score, record.verdict, record.flag) == expected
    if expected == ERROR:
        assert record.reason == fv.REPLY_ERROR_REASON


def test_prompt(one):
    assert one(replies.scoring_prompt, "Dev", "Acme", None, "") == (
        "Job to evaluate:\nTitle: Dev\nCompany: Acme\nLocation: \nDescription: " + fv.NO_DESCRIPTION_TEXT)
    assert one(replies.scoring_prompt, "Dev", "Acme", "NYC", "text").endswith("\nDescription: text")


def test_profile_is_put_into_the_template(one):
    assert one(lambda t: replies.fill_profile(t, "me {profile}"), "a {profile} b") == "a me {profile} b"
