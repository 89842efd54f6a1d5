import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cedarlog.functions import mask as m
from cedarlog.functions.variants import texts_of
from cedarlog.plans.ingest import structure

CASES = {
    "mail a.b+c@x.com. end": "mail <EMAIL_REDACTED> end",
    "u@1.2.3.4": "<EMAIL_REDACTED>",
    "1.2.3.4.5.6.7.8": "<IP_REDACTED>.<IP_REDACTED>",
    "1.1.1.1 2.2.2.2 3.3.3.3": "<IP_REDACTED> <IP_REDACTED> <IP_REDACTED>",
    "1.2.3.256 v10.0.0.1x": "1.2.3.256 v<IP_REDACTED>x",
    "ts 1700000000000 id": "ts <CC_REDACTED> id",
    "4111-1111-1111-1111 4111 1111 1111 1111": "<CC_REDACTED> <CC_REDACTED>",
    "12345678901234567": "12345678901234567",
    "123-45-6789": "<SSN_REDACTED>",
    "é4111111111111111": "é4111111111111111",
    "١٢٣-٤٥-٦٧٨٩": "<SSN_REDACTED>",
    "a@b.c_d@e.f": "<EMAIL_REDACTED><EMAIL_REDACTED>",
    "a@b a@b.c @x.y a@@b.c": "a@b <EMAIL_REDACTED> @x.y a@@b.c",
    "": "",
}

PYTHON = [
    (re.compile(p), mark)
    for p, mark in (
        (m.EMAIL, m.EMAIL_MARK), (m.IPV4, m.IPV4_MARK), (m.CARD, m.CARD_MARK), (m.SSN, m.SSN_MARK),
    )
]


def expected(text):
    for pattern, mark in PYTHON:
        text = pattern.sub(mark, text)
    return text


def masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", m.mask_text(F.col("t")).alias("m")).orderBy("i").collect()
    return [r.m for r in rows]


def test_golden_texts(spark):
    assert masked(spark, list(CASES)) == list(CASES.values())


def test_missing_text_stays_missing(spark):
    assert masked(spark, [None]) == [None]


PIECES = st.sampled_from(
    list("0123456789ab@._-+ \né٣") + ["10.0.0.1", "a@b.co", "411111111111", "123-45-", "6789", "256."]
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=150, max_size=150))
def test_same_as_the_plain_patterns_and_stable(spark, texts):
    got = masked(spark, texts)
    assert got == [expected(t) for t in texts]
    assert masked(spark, got) == [expected(t) for t in got]


def test_nested_json(spark):
    text = (
        '{"s":"a@b.co","n":1700000000000,"b":true,"o":{"ip":"10.0.0.1","d":{"x":"a@b.co"}},'
        '"l":["a@b.co",5,{"k":"a@b.co"}],"e":"tab\\tjoe@x.com","z":null}'
    )
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(m.mask_json(F.parse_json("t"), texts_of(F.col("t"))).alias("j")).first().j
    assert got == (
        '{"b":true,"e":"tab\\t<EMAIL_REDACTED>","l":["<EMAIL_REDACTED>",5,{"k":"a@b.co"}],'
        '"n":1700000000000,"o":{"d":{"x":"<EMAIL_REDACTED>"},"ip":"<IP_REDACTED>"},'
        '"s":"<EMAIL_REDACTED>","z":null}'
    )


def test_very_deep_objects_are_masked_too(spark):
    text = '{"a":' * 12 + '"x@y.com"' + "}" * 12
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(m.mask_json(F.parse_json("t"), texts_of(F.col("t"))).alias("j")).first().j
    assert "x@y.com" not in got and "EMAIL_REDACTED" in got
    # Below the bound numbers stay numbers, objects stay objects, and keys stay as they are.
    inner = '{"c@d.ee":4111111111111111,"n":"4111111111111111","q":"a \\\" b: 1.2.3.4","l":[1700000000000,"x@y.com"]}'
    text = '{"a":' * 12 + inner + "}" * 12
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(m.mask_json(F.parse_json("t"), texts_of(F.col("t"))).alias("j")).first().j
    assert got == '{"a":' * 12 + (
        '{"c@d.ee":4111111111111111,"l":[1700000000000,"<EMAIL_REDACTED>"],"n":"<CC_REDACTED>","q":"a \\\" b: <IP_REDACTED>"}') + "}" * 12


def test_nothing_leaks_into_a_stored_column(spark):
    lines = [
        "2025-11-20 10:00:01 INFO payment-service: Payment processed for user_id=101 amount=50.00",
        "2025-11-20 10:00:02 ERROR auth-service: Login failed for user=admin ip=192.168.1.5 reason=x",
        "2025-11-20 10:00:06 INFO email-service: Sending email to john.doe@example.com",
        "2025-11-20 10:00:07 INFO billing-service: Charging card 4111-1111-1111-1111 for $99.99",
        '{"message":"m","user":"a@b.co","net":{"ip":"1.2.3.4"},"esc":"\\u0061\\u0040b.co"}',
        '9.9.9.9 - - [24/Nov/2025:16:00:00 +0000] "GET /?m=a@b.co HTTP/1.1" 200 12',
        "Nov 24 16:00:00 10.1.1.1 s: m",
        "free text 123-45-6789",
    ]
    df = structure(spark.createDataFrame([(x,) for x in lines], "value string"), 2025, "2025-12-01 00:00:00")
    for c in ("message", "context", "host"):
        assert df.filter(m.leaks(F.col(c))).count() == 0, c
    assert df.count() == len(lines)
