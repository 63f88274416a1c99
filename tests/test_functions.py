import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from textsieve.functions import labels, replies, scores, text, tokens
from textsieve.functions.keys import ordered_key


@pytest.mark.parametrize("raw", [" a ", "\n\t a b \r\n", " x ", "\x1cx\x1f", "   ", "", "\x85a \n"])
def test_py_strip_equals_python(value, raw):
    assert value(text.py_strip(F.lit(raw))) == raw.strip()


@pytest.mark.parametrize(
    "raw",
    [
        "gpt4 foo_bar été don't abc²",
        "Hello, WORLD hello",
        "ab abc abcd ab1 1abc abc1",
        "naïve cafe-au-lait x_y",
        "",
        "abcdé éabcd abc-def",
    ],
)
def test_words_equal_python(value, raw):
    expected = [w for w in re.findall(r"\b[a-z]+\b", raw.lower()) if len(w) >= 3]
    assert value(text.word_list(F.lit(raw))) == expected
    assert sorted(value(text.distinct_words(F.lit(raw)))) == sorted(set(expected))


def test_words_of_the_trap_case(value):
    assert value(text.word_list(F.lit("gpt4 foo_bar été don't abc²"))) == ["don"]


def test_template_keeps_special_characters(value):
    raw = r"cost $1 \ {x} {text}"
    assert value(text.fill_template(F.lit(raw), "<{text}>")) == f"<{raw}>"
    with pytest.warns(UserWarning):
        assert value(text.fill_template(F.lit("a"), "no place")) == "no place"


def test_preview(value):
    assert value(text.preview(F.lit("x" * 200))) == "x" * 200
    assert value(text.preview(F.lit("x" * 201))) == "x" * 200 + "..."


def test_flatten_text(value):
    assert value(text.flatten_text(F.lit("\n a\nb \n"))) == "a b"


def test_instruction_prompt(value):
    train = value(text.instruction_prompt(F.lit("t"), "T {text}\n", F.lit(0)))
    assert train == "<bos><start_of_turn>user\nT t<end_of_turn>\n<start_of_turn>model\nNo<end_of_turn>\n"
    infer = value(text.instruction_prompt(F.lit("t"), "T {text}\n"))
    assert infer.endswith("<end_of_turn>\n<start_of_turn>model\n")
    assert value(text.has_chat_markers(F.lit(infer)))


@pytest.mark.parametrize(
    "name, label",
    [("a_Positive.parquet", 1), ("NEGATIVE", 0), ("positive_negative", 1), ("other", None), (None, None)],
)
def test_filename_label(value, name, label):
    assert value(labels.filename_label(F.lit(name))) == label


def test_normalize_label(value):
    cases = [
        (F.lit(1), 1, "yes"), (F.lit(2), 0, "no"), (F.lit(1.0), 1, "yes"), (F.lit(float("nan")), 0, "no"),
        (F.lit(True), 1, "yes"), (F.lit(" TRUE "), 1, "yes"), (F.lit("no"), 0, "no"), (F.lit("1.0"), 0, "1.0"),
        (F.lit(" Maybe\n"), 0, "maybe"), (F.lit(None).cast("string"), 0, "no"), (F.lit(None).cast("int"), 0, "no"),
    ]
    for raw, as_int, as_str in cases:
        assert value(labels.normalize_label(raw, "int")) == as_int
        assert value(labels.normalize_label(raw, "str")) == as_str
    with pytest.raises(ValueError):
        labels.normalize_label(F.lit(1), "float")


def test_class_names(value):
    assert value(labels.class_name(F.lit(1))) == "ai"
    assert value(labels.class_id(F.lit("nonai"))) == 0
    assert value(labels.class_id(F.lit("none"))) is None


@pytest.mark.parametrize(
    "reply, answer",
    [
        ("Yes", "yes"), (" NO \n", "no"), ("yesterday", "yes"), ("nothing", "no"), ("maybe no or yes", "no"),
        ("i think yes", "yes"), ("ERROR: no route", "no"), ("unsure", "unknown"), ("", "unknown"),
        ("say: éno yes", "yes"), ("it is unknown", "unknown"),
    ],
)
def test_extract_yes_no(value, reply, answer):
    assert value(replies.extract_yes_no(F.lit(reply))) == answer


def test_correctness_is_three_valued(value):
    def right(a, b):
        return replies.correctness(F.lit(a), F.lit(b).cast("string"))

    assert value(right("yes", "yes")) is True
    assert value(right("no", "yes")) is False
    assert value(right("unknown", "yes")) is None
    assert value(right("yes", None)) is None
    states = [("yes", "yes"), ("no", "yes"), ("unknown", "yes"), ("yes", None)]
    assert [value(replies.status(right(a, b), F.lit(a))) for a, b in states] == [
        "CORRECT", "INCORRECT", "UNKNOWN", "N/A",
    ]


def _top(*pairs):
    items = [F.struct(F.lit(t).alias("token"), F.lit(p).alias("logprob")) for t, p in pairs]
    return F.array(*items) if items else F.array().cast("array<struct<token:string,logprob:double>>")


def test_prob_from_logprobs(value):
    none = F.lit(None).cast("string")

    def prob(top, reply="", error=none):
        return value(scores.prob_from_logprobs(top, F.lit(reply), error))

    y, n = math.exp(-0.1), math.exp(-2.0)
    assert prob(_top((" Yes", -0.1), ("no\n", -2.0))) == pytest.approx(y / (y + n))
    assert prob(_top(("Yes", -5.0), (" yes", -0.1), ("NO", -2.0))) == pytest.approx(y / (y + n))
    assert prob(_top(("yes", -0.1))) == pytest.approx(y)
    assert prob(_top(("no", -2.0))) == pytest.approx(1 - n)
    assert prob(_top(("maybe", -2.0)), " Yes!") == 1.0
    assert prob(_top(), "perhaps") == 0.0
    assert prob(_top(("yes", -0.1)), "yes", F.lit("timeout")) == 0.5
    assert prob(_top(("yes", -900.0), ("no", -901.0))) == pytest.approx(1 / (1 + math.exp(-1)))


def test_scores_are_stable(value):
    assert value(scores.prob_from_scores(F.lit(0.0), F.lit(5000.0))) == 1.0
    assert value(scores.prob_from_scores(F.lit(5000.0), F.lit(0.0))) == 0.0
    p = value(scores.prob_from_variants(F.array(F.lit(1000.0), F.lit(999.0)), F.array(F.lit(1000.0))))
    assert p == pytest.approx(1 / (2 + math.exp(-1)))


def test_decisions(value):
    assert value(scores.decide(F.lit(0.5), 0.5)) == 1
    assert value(scores.decide_logits(F.lit(1.0), F.lit(1.0))) == 0
    assert value(scores.argmax_class(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 1
    assert value(scores.confidence(F.lit(0.2), F.lit(0))) == pytest.approx(0.8)


def test_class_probability(value):
    both = F.array(F.lit("__label__nonai"), F.lit("__label__ai"))
    probs = F.array(F.lit(0.7), F.lit(0.3))
    assert value(scores.class_probability(both, probs, "__label__ai")) == 0.3
    assert value(scores.class_probability(F.array(F.lit("x")), F.array(F.lit(0.9)), "__label__ai")) == 0.5
    assert value(scores.top_class(both, probs)).asDict() == {"label": "nonai", "confidence": 0.7}


def _ints(xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


def _mask(ids, yes, no, position):
    """Masking spelled out as a loop."""
    longest = max(len(yes), len(no))
    stop = len(ids) - longest if position == "first" else len(ids)
    found = [i for i in range(max(stop, 0)) if ids[i : i + len(yes)] == yes or ids[i : i + len(no)] == no]
    if not found:
        return ids
    at = found[0] if position == "first" else found[-1]
    return [-100] * at + ids[at:]


@pytest.mark.parametrize("yes, no", [([7], [8]), ([7, 1], [8]), ([7, 1], [8, 2, 3])])
def test_mask_prompt_equals_a_loop(spark, yes, no):
    rng = random.Random(len(yes) * 10 + len(no))
    data = [(i, [rng.choice([1, 2, 3, 7, 8]) for _ in range(rng.randrange(0, 12))]) for i in range(150)]
    df = spark.createDataFrame(data, "i int, ids array<int>")
    got = df.select(
        "ids",
        tokens.mask_prompt(F.col("ids"), yes, no).alias("last"),
        tokens.mask_prompt(F.col("ids"), yes, no, "first").alias("first"),
    ).collect()
    for row in got:
        assert row["last"] == _mask(row["ids"], yes, no, "last")
        assert row["first"] == _mask(row["ids"], yes, no, "first")


def test_answer_position(value):
    assert value(tokens.answer_position(_ints([-100, -100, 7, 5]), 7)).asDict() == {
        "position": 2, "token": 7, "true_class": 1,
    }
    assert value(tokens.answer_position(_ints([-100, 8]), 7))["true_class"] == 0
    assert value(tokens.answer_position(_ints([-100]), 7)) is None


@pytest.mark.parametrize("n, chunks", [(0, 1), (1, 1), (30000, 1), (30001, 2), (58000, 2), (58001, 3)])
def test_chunk_count(value, n, chunks):
    assert value(tokens.chunk_count(F.lit(n), 30000, 2000)) == chunks


def test_truncate(value):
    assert value(tokens.truncate_tokens(_ints([1, 2, 3]), 2)) == [1, 2]


def test_token_count(value):
    assert value(text.token_count(F.lit("a  b\nc.d"))) == 3
    assert value(text.token_count(F.lit("a  b\nc.d"), "word")) == 5
    with pytest.raises(ValueError):
        text.token_count(F.lit(""), "other")


def test_ordered_key_sorts_like_the_number(spark):
    rng = random.Random(1)
    numbers = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    numbers += [rng.random() for _ in range(1000)] + [2.0**e for e in range(-1074, 1024, 7)]
    numbers += [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 0.1]
    numbers = sorted({x for x in numbers if not math.isnan(x)})
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    rows = df.select("x", ordered_key(F.col("x")).alias("k")).collect()
    by_key = [r["x"] for r in sorted(rows, key=lambda r: r["k"])]
    assert by_key == numbers
    assert len({r["k"] for r in rows}) == len(numbers)


def test_ordered_key_special_values(value):
    assert value(ordered_key(F.lit(float("nan")))) is None
    assert value(ordered_key(F.lit(None).cast("double"))) is None
    assert value(ordered_key(F.lit(-0.0))) == value(ordered_key(F.lit(0.0))) == 0
