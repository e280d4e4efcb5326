"""Reply parsing, rules, translation, prompts and the model seam."""

import json

import pytest
from pyspark.sql import functions as F

from mailtables.operators import analysis as A, inference as I, prompts as PR, translation as T

COLUMNS = "rec_id long, subject string, body string, analysis_text string, summary_text string, action_text string, in_tokens long, out_tokens long, latency_ms long"


@pytest.fixture
def analysed(spark):
    def run(*replies, body="First part. Second part", summary="A summary", action=None):
        rows = [
            (i, "s", body, r if r is None or isinstance(r, str) else json.dumps(r), summary, action, 5, 2, 7)
            for i, r in enumerate(replies)
        ]
        return A.analyse(spark.createDataFrame(rows, COLUMNS)).orderBy("rec_id").collect()

    return run


GOOD = {"classification": {"category": "billing", "confidence": 0.9}, "summary": "x", "confidence_scores": {"overall": 0.9}}


def test_object_is_found_in_prose(analysed):
    fenced = "```json\n" + json.dumps(GOOD) + "\n```"
    prose = "Sure: " + json.dumps(GOOD) + " Bye."
    broken = ["no json", "{bad}", json.dumps(GOOD) + " and " + json.dumps(GOOD), None, "[]", '{"a":1,}']
    rows = analysed(GOOD, fenced, prose, *broken)
    assert [r.failure for r in rows] == [None] * 3 + ["analysis"] * 6
    assert rows[3].summary == 'Email analysis failed. Original subject: "s". First sentence: "First part"'
    assert rows[3].review_reason == A.ANALYSIS_FAILED and rows[3].requires_human_review


def test_confidences_follow_javascript(analysed):
    def reply(value):
        return GOOD | {"classification": {"confidence": value}, "confidence_scores": {"overall": 0.9, "classification": value}}

    values = [0.5, 0, 2, -1, "0.9", "x", None, True, "", [], {}]
    rows = analysed(*[reply(v) for v in values])
    assert [r.classification.confidence for r in rows] == [0.5, 0.0, 1.0, 0.0] + [0.7] * 7
    assert [r.confidence_scores.classification for r in rows] == [0.5, 0.7, 1.0, 0.0, 0.9, 0.7, 0.7, 1.0, 0.7, 0.7, 0.7]


def test_failure_rules(analysed):
    cases = [
        (GOOD | {"confidence_scores": None}, "analysis"),
        ({"classification": {}, "summary": "x"}, "analysis"),
        ({"classification": {}}, None),
        (GOOD | {"action_items": {"a": 1}}, "analysis"),
        (GOOD | {"action_items": "text"}, "analysis"),
        (GOOD | {"action_items": ""}, None),
        (GOOD | {"action_items": ["a"]}, "analysis"),
        (GOOD | {"action_items": [None, 0, "", {"action": "a"}]}, None),
        (GOOD | {"classification": "billing"}, "analysis"),
        (GOOD | {"classification": 0}, None),
        (GOOD | {"classification": []}, None),
        (GOOD | {"confidence_scores": 5}, None),
    ]
    rows = analysed(*[reply for reply, _ in cases])
    assert [r.failure for r in rows] == [failure for _, failure in cases]


def test_missing_summary_reply_fails_only_where_it_is_needed(analysed):
    low = GOOD | {"confidence_scores": {"overall": 0.2}}
    rows = analysed(GOOD, low, {"classification": {}}, summary=None)
    assert [r.failure for r in rows] == [None, "analysis", "analysis"]


def test_summary_sources(analysed):
    low = GOOD | {"confidence_scores": {"overall": 0.2}}
    assert [r.summary for r in analysed(GOOD, low, summary=" \"Summary: it's `fine`\" ")] == ["x", "its fine"]
    built = analysed(low, {"classification": {}}, summary="")
    assert [r.summary for r in built] == [
        "Email about billing (medium priority, neutral sentiment). First part",
        "Email about general inquiry (medium priority, neutral sentiment). First part",
    ]
    assert analysed(low, summary="", body=". x")[0].summary.endswith("). . x")


def test_null_body_breaks_the_pipeline_only_when_the_sentence_is_needed(analysed):
    rows = analysed(GOOD, "no json", body=None)
    assert [r.failure for r in rows] == [None, "pipeline"]
    assert rows[1].summary == 'Email processing failed. Original subject: "s". Requires manual review.'
    assert rows[1].action_confidence == 0.5 and rows[1].action_reasoning == A.PIPELINE_FAILED


def test_review_rules(analysed):
    def reply(scores, **cls):
        return {"classification": cls, "summary": "x", "confidence_scores": scores}

    cases = [
        (reply({"overall": 0.65}), "low overall confidence (0.65)"),
        (reply({"overall": None}), "low overall confidence (null)"),
        (reply({"overall": 0}), "low overall confidence (0)"),
        (reply({"overall": "0.50"}), "low overall confidence (0.50)"),
        (reply({"overall": 0.0005}), "low overall confidence (0.0005)"),
        (reply({"overall": 1e-7}), "low overall confidence (1e-7)"),
        (reply({"overall": -3}), "low overall confidence (-3)"),
        (reply({"overall": "x"}), None),
        (reply({}), None),
        (reply({}, category="other", confidence=0.75), "uncertain category classification"),
        (reply({}, priority="medium", confidence=0.72), "uncertain priority classification"),
        (
            reply({}, category="other", priority="medium", confidence=0.1),
            "low classification confidence (0.1), uncertain category classification, uncertain priority classification",
        ),
        (reply({"action_items": 0.8}), "no action items despite high confidence"),
        (reply({"action_items": 0.8}) | {"action_items": [{"action": "a"}]}, None),
    ]
    rows = analysed(*[c for c, _ in cases])
    assert [r.review_reason for r in rows] == [r and f"Requires review: {r}" for _, r in cases]
    assert all(r.requires_human_review == (r.review_reason is not None) for r in rows)


def test_planner(analysed):
    plan = '{"action":"Create new ticket","confidence":3,"reasoning":"r"}'
    review = GOOD | {"confidence_scores": {"overall": 0.1}}
    rows = analysed(GOOD, review, action=plan)
    assert [(r.next_best_action, r.action_confidence, r.action_reasoning) for r in rows] == [
        ("Create new ticket", 1.0, "r"),
        ("Escalate to agent", 0.7, "Requires review: low overall confidence (0.1)"),
    ]
    assert analysed(GOOD, action="{}")[0].action_reasoning == A.NO_REASONING
    assert analysed(GOOD)[0].action_reasoning == A.PLAN_FAILED


def test_structured_data_and_json(analysed, spark):
    reply = GOOD | {"structured_data": {"b": {"value": "x", "confidence": 0.5}, "a": {"value": None}, "confidence": 2}}
    row = analysed(reply)[0]
    assert [(e.key, e.value, e.confidence) for e in row.structured_data] == [("a", None, None), ("b", "x", 0.5)]
    assert row.structured_confidence == 2.0
    df = spark.createDataFrame([(0, "s", "b.", json.dumps(reply), "t", None, 5, 2, 7)], COLUMNS)
    shaped = json.loads(A.analyse(df).select(A.analysis_json()).first()[0])
    assert shaped["structured_data"]["b"] == {"confidence": 0.5, "value": "x"} and shaped["structured_data"]["confidence"] == 2
    assert shaped["tokenUsage"] == {"inputTokens": 5, "outputTokens": 2, "totalTokens": 7}
    assert shaped["next_best_action"] == "Escalate to agent" and shaped["processing_time_ms"] == 7


def test_failed_analysis_counts_no_tokens(analysed):
    rows = analysed(GOOD, None)
    assert [r.token_usage.total for r in rows] == [7, 0]


MAILS = [
    (1, "مرحبا", "body", "Subject: Hi\n\nAll good\n"),
    (2, "plain", "نص", "\nrest only"),
    (3, "plain", "english", "ignored"),
    (4, "مرحبا", "b", None),
    (5, None, "نص", "only first"),
    (6, None, None, "x"),
]


def test_email_translation(spark):
    df = spark.createDataFrame(MAILS, "rec_id long, subject string, body string, translation_text string")
    rows = T.apply_email_translation(df).orderBy("rec_id").collect()
    assert [(r.subject, r.body, r.language, r.was_translated) for r in rows] == [
        ("Subject: Hi", "All good", "ar", True),
        ("plain", "rest only", "ar", True),
        ("plain", "english", "en", False),
        ("مرحبا", "b", "ar", False),
        ("only first", "نص", "ar", True),
        (None, None, "en", False),
    ]
    assert json.loads(rows[0].translated_content) == {"subject": "Subject: Hi", "body": "All good"}
    assert rows[3].translated_content is None and rows[0].original_subject == "مرحبا"
    prompts = T.translation_prompts(df)
    assert sorted(r.rec_id for r in prompts.collect()) == [1, 2, 4, 5]


def test_templates_take_values_literally(spark):
    df = spark.createDataFrame([("$& $1 {{B}} \\1", "x")], "a string, b string")
    got = df.select(T.fill("<{{A}}|{{B}}|{{A}}>", A=F.col("a"), B=F.col("b"))).first()[0]
    assert got == "<$& $1 {{B}} \\1|x|{{A}}>"


def test_analysis_prompt_without_subject(spark):
    df = spark.createDataFrame([(1, None, "b")], "rec_id long, subject string, body string")
    assert "Subject: \n\nBody:\nb" in PR.analysis_prompts(df).first().prompt


def test_model_errors_cost_one_row(spark):
    df = spark.range(50).select(F.col("id").alias("rec_id"), F.lit("k").alias("kind"), F.col("id").cast("string").alias("prompt"))

    def model(prompts):
        if "13" in prompts:
            raise ValueError("no")
        return [{"reply": p + "!", "in_tokens": 1} if p != "7" else {"error": "unfit"} for p in prompts]

    rows = {r.rec_id: r for r in I.infer_batches(df, model, concurrency=3).collect()}
    assert len(rows) == 50 and rows[13].reply is None and rows[13].error == "ValueError: no"
    assert rows[7].reply is None and rows[7].error == "unfit"
    assert all(r.reply == f"{i}!" and r.error is None for i, r in rows.items() if i not in (7, 13))


def test_a_service_that_is_down_is_asked_a_few_times_only(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("rec_id"), F.lit("k").alias("kind"), F.col("id").cast("string").alias("prompt"))
    log = str(tmp_path / "calls")

    def model(prompts):
        with open(log, "a") as f:
            f.write("x")
        raise ConnectionError("down")

    rows = I.infer_batches(df.coalesce(1), model, pause=0).collect()
    assert len(rows) == 40 and {r.error for r in rows} == {"ConnectionError: down"}
    assert len(open(log).read()) == 3


def test_further_members_of_replies_are_kept(spark):
    reply = (
        '{"classification":{"category":"billing","confidence":2,"subcategory":"x","by":{"id":1}},"confidence_scores":{"overall":0.9},'
        '"action_items":[{"action":"a","due":"now"},null,[1]],"structured_data":{"n":5,"acc":{"value":"v","unit":"u"}},"summary":"s"}'
    )
    rows = spark.createDataFrame([(1, reply), (2, "none"), (3, None)], "rec_id int, analysis_text string")
    got = {r.rec_id: r for r in A.normalise_analysis(A.parse_analysis(rows)).select("rec_id", *[F.to_json(c).alias(c) for c in A.OPEN]).collect()}
    assert got[1].classification_object == '{"by":{"id":1},"category":"billing","confidence":1.0,"subcategory":"x"}'
    assert got[1].structured_object == '{"acc":{"unit":"u","value":"v"},"confidence":0.7,"n":5}'
    assert got[1].action_objects == '[{"action":"a","confidence":0.7,"due":"now"},null,[1]]'
    assert got[2].structured_object == got[3].classification_object == '{"confidence":0.7}' and got[3].action_objects == "[]"
