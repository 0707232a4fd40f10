from factweave.operators import candidates, export

A = "<stmt><subject type=\"ORG\">Acme </subject><object>Bolt</object><predicate>Sells</predicate><text>t1</text></stmt>"
A2 = "<stmt><object>bolt</object><subject> ACME</subject><predicate>sells</predicate><text>longer text</text></stmt>"
B = "<stmt><subject>x</subject><predicate>p</predicate></stmt>"
B2 = "<stmt><subject>x</subject><object> </object><predicate>P</predicate><note>kept</note></stmt>"


def test_first_of_equal_statements_stays_as_written(spark):
    cases = {
        f"<statements>{A}\n{B}{A2}{B2}</statements>": f"<statements>{A}{B}</statements>",
        f"  <statements>{A2}{A}</statements>": f"<statements>{A2}</statements>",
        f"<statements>{A}{B}</statements>": f"<statements>{A}{B}</statements>",
        f"<answers>{A}{A}</answers>": f"<answers>{A}{A}</answers>",
        f"<statements>{A}{A}": f"<statements>{A}{A}",
        "no xml": "no xml",
        "": "",
    }
    df = spark.createDataFrame([(i, c, "clash") for i, c in enumerate(cases)] + [(99, None, "clash")], "id int, xml string, s string")
    got = {r["id"]: r["xml"] for r in candidates.deduplicated_xml(df, "xml").collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}
    assert candidates.deduplicated_xml(df, "xml").columns == ["id", "xml", "s"]
    assert candidates.deduplicated_xml(df.limit(0), "xml").count() == 0


def test_longest_is_chosen_after_repeats_are_out(spark):
    twice, both = f"<statements>{A}{A}{A}</statements>", f"<statements>{A}{B}</statements>"
    rows = [(1, 0, 0, twice, 2), (1, 0, 1, both, 2), (1, 1, 0, f"<statements>{A}{B}{A2.replace('bolt', 'nut')}</statements>", 2), (2, 0, 0, f"<statements>{B}</statements>", 5), (2, 1, 0, f"<statements>{A}</statements>", 5)]
    df = spark.createDataFrame(rows, "k int, attempt int, n int, xml string, expected int")
    got = {r["k"]: r["xml"] for r in candidates.longest_raw_xml(df, ["k"], "xml", "attempt", "expected", ["n"]).collect()}
    assert got == {1: both, 2: f"<statements>{A}</statements>"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_gone_through_and_parsed_once(spark):
    body = f"<statements>{A}</statements>"
    df = spark.range(4).selectExpr("id", f"CASE WHEN id < 3 THEN '{body}' END AS body", "1 AS attempt", "2 AS expected")
    read, best = export.read_answers(df, "body"), candidates.longest_raw_xml(df, ["id"], "body", "attempt", "expected", [])
    for out in (read, best, candidates.parse_statements_xml(df, "body", repair=False)):
        assert plan(out).count("Range (") == 1 and plan(out).count("from_xml(") == 1, plan(out)
    assert [(r["id"], r["form"], r["subject"]) for r in read.orderBy("id").collect()] == [(i, "xml", "Acme") for i in range(3)]
    js = plan(export.parse_statements_json(spark.range(2).selectExpr("concat('[', id) AS body"), "body"))
    assert js.count("labeled_statements, StringType") <= 1 and js.count("$.labeled_statements") == 1


def test_an_attempt_without_enough_is_followed_by_the_next(spark):
    few, many = f"<statements>{A}</statements>", f"<statements>{A}{B}</statements>"
    long_few = f"<statements>{A.replace('t1', 'a text that is longer than two statements are together, ' * 3)}</statements>"
    rows = [(1, 0, 0, few), (1, 1, 0, long_few), (1, 1, 1, many), (1, 2, 0, long_few.replace("than", "than all")), (2, 0, 0, None), (2, 3, 0, few)]
    df = spark.createDataFrame(rows, "k int, attempt int, n int, xml string").selectExpr("*", "2 AS expected")
    got = {r["k"]: r["xml"] for r in candidates.longest_raw_xml(df, ["k"], "xml", "attempt", "expected", ["n"]).collect()}
    assert got == {1: long_few, 2: few}
