"""Golden rendering cases (FIXTURES.md): B7, B9, B15, F15, B1."""

from pyspark.sql import functions as F

from loam.functions.text import clean_label, format_numbers, title_case
from loam.operators.messages import to_messages
from loam.operators.prompts import multiple_choice_prompt, persona_prompt


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_multiple_choice(spark):
    got = one(spark, multiple_choice_prompt(F.lit("Q?"), F.array(F.lit("x"), F.lit("y"), F.lit("z"))))
    assert got == "Question: Q?\n\nA. x\nB. y\nC. z\n\nAnswer with only the letter (A, B or C)"


def test_format_numbers(spark):
    nums = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, format_numbers(nums, F.lit("Return numbers separated by semicolons."))) == "1; 2; 3"
    assert one(spark, format_numbers(
        nums, F.lit("Return the numbers in the following format: (number_1, number_2, ...)."))) == "(1, 2, 3)"
    assert one(spark, format_numbers(nums, F.lit(""))) == "1, 2, 3"


def test_persona(spark):
    assert one(spark, persona_prompt(F.lit("animal"), F.lit("wolf"))) == (
        "You love wolves. You think about wolves all the time. wolves are your favorite animal. "
        "Imbue your answers with your love for wolves.")
    assert "You love dogs." in one(spark, persona_prompt(F.lit("animal"), F.lit("dog")))
    assert "favorite tree" in one(spark, persona_prompt(F.lit("tree"), F.lit("oak")))


def test_labels_and_title(spark):
    assert one(spark, clean_label(F.lit(" ANIMALS.\n"))) == "animals"
    assert one(spark, title_case(F.lit("red-panda o'neil"))) == "Red-Panda O'Neil"


def test_to_messages_drops_nulls(spark):
    m = one(spark, to_messages(F.lit(None).cast("string"), F.lit("hi"), F.lit("yo")))
    assert [(x.role, x.content) for x in m] == [("user", "hi"), ("assistant", "yo")]


def test_special_tokens_stripped_before_parse(spark):
    from loam.functions.text import strip_special_tokens, with_parsed_numbers

    df = spark.createDataFrame([("<start_of_turn>1, 2, 3<end_of_turn>",), ("<assistant>4 5<user>",)], "r string")
    got = [r.n for r in with_parsed_numbers(df, strip_special_tokens(F.col("r")), "x").select(F.array_join("x", ",").alias("n")).collect()]
    assert got == ["1,2,3", "4,5"]


def test_template_segments(spark):
    from loam.operators.messages import GEMMA_STYLE, render_chat, template_segments

    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("__U__").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.lit("__A__").alias("content")))
    seg = one(spark, template_segments(render_chat(msgs, GEMMA_STYLE, False), "__U__", "__A__"))
    assert seg.assistant_prefix == "<end_of_turn>\n<start_of_turn>model\n"
    assert seg.user_prefix == "<bos><start_of_turn>user\n"
