from pyspark.sql import functions as F

from cedarlog.operators import chat as c
from cedarlog.operators import rules as r
from cedarlog.operators import scoring as s


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "service_name string, attempt int, pattern string")


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "service_name string, line string")


GOLDEN = [
    ("mill", "08:30:01 | WARN | mill-2 | stone speed 118 of 120"),
    ("mill", "08:30:09 | INFO | mill-1 | sack 40 closed"),
    ("bus", "line=12 stop=Harbour late=4min driver wrote: ice on the bridge"),
    ("bus", "line=7 stop=Museum late=0min driver wrote: nothing"),
]
MILL = r"(?P<clock>\d\d:\d\d:\d\d) \| (?P<level>[A-Z]+) \| (?P<unit>[a-z]+-\d) \| (?P<text>.*)"
BUS = r"line=(?P<line>\d+) stop=(?P<stop>\w+) late=(?P<late>\d+)min driver wrote: (?P<note>.*)"


def verdicts(df):
    return {(x.service_name, x.attempt): x.ok for x in df.collect()}


def test_validation(spark):
    table = rules(
        spark, ("mill", 1, MILL), ("mill", 2, ".*"), ("mill", 3, "("), ("mill", 4, "(?P<a>stone)"),
        ("bus", 1, BUS), ("bus", 2, MILL),
    )
    want = {
        ("mill", 1): True, ("mill", 2): False, ("mill", 3): False, ("mill", 4): False,
        ("bus", 1): True, ("bus", 2): False,
    }
    assert verdicts(r.validate_rules(lines(spark, *GOLDEN), table)) == want
    assert verdicts(r._validate_by_join(lines(spark, *GOLDEN), table, "line", True)) == want


def test_first_passing_attempt_wins(spark):
    table = rules(spark, ("mill", 1, "("), ("mill", 2, MILL), ("bus", 1, "x(?P<a>y)"), ("bus", 4, BUS))
    got = {x.service_name: (x.attempt, x.pattern) for x in r.select_rules(lines(spark, *GOLDEN), table).collect()}
    assert got == {"mill": (2, MILL), "bus": (None, None)}


def test_rules_extract_fields_by_literal_and_by_join(spark):
    table = rules(spark, ("mill", 1, "nope(?P<x>.)"), ("mill", 2, MILL), ("bus", 1, BUS))
    data = lines(spark, *GOLDEN, ("other", "text"))
    for done in (r.apply_rules(data, table), r._apply_by_join(data, table, "line")):
        got = {x.line: x.fields for x in done.collect()}
        assert got[GOLDEN[0][1]]["level"] == "WARN"
        assert got[GOLDEN[2][1]] == {"line": "12", "stop": "Harbour", "late": "4", "note": "ice on the bridge"}
        assert got["text"] is None


def test_patterns_are_translated(spark):
    java, fields = r.translate(r"(?P<a>x)(y)(?P<b>z)(?P=a)")
    assert fields == ("a", "group_2", "b") and java == r"(?U)^(?:(x)(y)(z)\1)"
    assert r.translate("(a+") == (None, ())
    assert r.translate(r"(?P<a>.*[[])")[0] == r"(?U)^(?:(.*[\[]))"
    assert r.translate(r"(?P<a>\w{,3})[]&x]\Z")[0] == r"(?U)^(?:(\w{0,3})[\]\&x]\z)"


def test_valid_patterns_cannot_fail_a_job(spark):
    patterns = [r"(?P<a>.*[[])", r"(?P<a>\w{,3}).*", r"(?P<a>(?:\w+\s?)+).*", r"(?P<a>[a-z&&]+)\Z", r"(?P<a>x)(?(1)y|z)"]
    table = rules(spark, *[("s", i, p) for i, p in enumerate(patterns)])
    data = lines(spark, ("s", "abc ["))
    assert verdicts(r.validate_rules(data, table)) == {
        ("s", 0): True, ("s", 1): True, ("s", 2): True, ("s", 3): False, ("s", 4): False,
    }
    assert r.apply_rules(data, table).first().fields == {"a": "abc ["}


def test_many_rules_give_what_few_rules_give(spark):
    """Above the bound the pattern is a column; one that only Python takes must not fail the job."""
    wanted = [("mill", 1, r"(?P<w>a)(?(w)b|c)"), ("mill", 2, "("), ("mill", 3, MILL), ("bus", 1, BUS), ("bus", 2, ".*")]
    rest = [(f"service-{i}", 1, rf"(?P<n>line {i}) .*") for i in range(600)]
    data = lines(spark, *GOLDEN, ("service-7", "line 7 and more"), ("service-8", "other"))
    few, many = rules(spark, *wanted, *rest[:20]), rules(spark, *wanted, *rest)
    assert r.load_rules(many) is None and r.load_rules(few) is not None
    small, large = verdicts(r.validate_rules(data, few)), verdicts(r.validate_rules(data, many))
    assert large == {**{(name, a): True for name, a, _ in rest}, **small} and not large["mill", 1]
    chosen = [{x.service_name: (x.attempt, x.pattern) for x in r.select_rules(data, t).collect()} for t in (few, many)]
    assert chosen[0] == chosen[1] and chosen[0]["mill"] == (3, MILL)
    fields = [{x.line: x.fields for x in r.apply_rules(data, t).collect()} for t in (few, many)]
    assert fields[0] == fields[1] and fields[0]["line 7 and more"] == {"n": "line 7"}
    assert [x.score for x in s.regex_scores(
        spark.createDataFrame([("a", "x")], "id string, line string"),
        spark.createDataFrame([("a", r"(?P<w>x)?(?(w)|c)")] + [(f"i{i}", "(") for i in range(600)], "id string, predicted string"),
    ).filter("id = 'a'").collect()] == [0.0]


def test_equal_attempts_go_by_pattern(spark):
    table = rules(spark, ("s", 1, "(?P<z>abc)"), ("s", 1, "(?P<b>abc)"))
    data = lines(spark, ("s", "abc"))
    assert [x.first().fields for x in (r.apply_rules(data, table), r._apply_by_join(data, table, "line"))] == [{"b": "abc"}] * 2


def test_regex_score(spark):
    samples = spark.createDataFrame([(k, v) for k, v in GOLDEN], "id string, line string")
    asked = spark.createDataFrame([("mill", ".*"), ("bus", "(")], "id string, predicted string")
    got = {x.id: x.score for x in s.regex_scores(samples, asked).collect()}
    assert got == {"mill": 1.0, "bus": 0.0}


def scores(spark, fn, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, e string")
    return [x[0] for x in df.orderBy("i").select(fn(F.col("p"), F.col("e"))).collect()]


def test_sql_and_answer_scores(spark):
    assert scores(
        spark, s.sql_score, ("SELECT  COUNT(*)\nFROM logs", "select count(*) from logs"),
        ("select 1", "select 2"), ("", ""), (None, "x"),
    ) == [1.0, 0.0, 0.0, 0.0]
    assert scores(
        spark, s.answer_score, ("a b c", "B c d"), ("", "a"), ("a", "  "), (None, "a"), ("a a", "a"),
    ) == [0.5, 0.0, 0.0, 0.0, 1.0]


def test_compare_runs(spark):
    run = lambda *v: spark.createDataFrame([(x,) for x in v], "score double")
    verdict = lambda a, b: s.compare_runs(a, b).first().verdict
    assert verdict(run(1.0, 1.0), run(0.0, 1.0)) == "first"
    assert verdict(run(0.0), run(1.0)) == "second"
    assert verdict(run(0.5), run(0.5, 0.5)) == "equal"


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [x[0] for x in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_intent_words(spark):
    assert values(
        spark, c.keyword_intent, "Why so many errors?", "Show me", "hello", "How many?", "PREFIX it",
    ) == ["knowledge_query", "data_query", "unknown", "data_query", "knowledge_query"]


def test_label_prefix_and_fence_cleanup(spark):
    assert values(spark, c.normal_label, " SQL ", "unknown_intent", "Rag\n") == ["sql", "ambiguous", "rag"]
    assert values(
        spark, c.without_prefixes, "Here is the rewritten query: Query: list errors", "query: x", "plain",
    ) == ["list errors", "x", "plain"]
    assert values(spark, c.without_fences, "```sql\nselect 1\n```", "select 2") == ["select 1", "select 2"]


def test_transcript_and_prompt(spark):
    chat = spark.createDataFrame(
        [("s", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(14)],
        "session_id string, turn int, role string, content string",
    )
    text = c.transcripts(chat, "session_id", "turn").first().transcript
    assert text.startswith("User: m4\nAI: m5\n") and text.endswith("AI: m13\n")
    df = spark.createDataFrame([("q {context}", "ctx", "")], "q string, c string, h string")
    prompt = df.select(c.fill_prompt(F.col("q"), F.col("c"), F.col("h"))).first()[0]
    assert "No previous history." in prompt and "q {context}" in prompt and "ctx" in prompt


def test_answer_context(spark):
    df = spark.createDataFrame(
        [("sql", "q", "r", None, None), ("sql", "q", None, "boom", None), ("rag", None, None, None, "d"),
         ("ambiguous", None, None, None, None)],
        "i string, s string, r string, e string, d string",
    )
    got = [x[0] for x in df.select(c.answer_context(*[F.col(n) for n in "isred"])).collect()]
    assert got == ["SQL: q\nResult: r", "SQL Error: boom", "Retrieved Context: d", "Ambiguous intent."]
