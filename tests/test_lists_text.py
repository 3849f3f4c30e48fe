"""List cells, Python-compatible strip, ordered phrase rules, comparison split."""


from stancelab.functions.lists import list_item, none_to_null, normalise_list, split_comparison, split_list
from stancelab.functions.text import first_phrase_label, py_strip


def test_split_and_normalise(spark):
    df = spark.createDataFrame([("a , ,b",), (None,), ("  x\t, y ",), ("None",), ("",)], "c string")
    rows = df.select(split_list("c").alias("l"), normalise_list("c").alias("n"),
                     normalise_list(none_to_null("c")).alias("nn"), list_item(split_list("c"), 1).alias("i1")
                     ).collect()
    assert rows[0].l == ["a", "b"] and rows[0].n == "a,b" and rows[0].i1 == "b"
    assert rows[1].l == [] and rows[1].n == "" and rows[1].i1 == ""
    assert rows[2].l == ["x", "y"]
    assert rows[3].n == "None" and rows[3].nn == ""
    assert rows[4].l == []


def test_py_strip_matches_python(spark):
    samples = ["  a b \n", "　x ", "\x0bq\x1c", "", "no-op", "\t\r\n"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(py_strip("t")).collect()]
    assert got == [s.strip() for s in samples]


def test_phrase_rules_order_and_fallback(spark):
    texts = [" My stance on X is that I think it is a", " I think masks are a", "  plain  ", None,
             "In my opinion, I believe that", "personally, i am"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(first_phrase_label("t")).collect()]
    assert got == ["My stance on...", "I think...", "plain", "", "In my opinion...", "personally, i am"]


def test_split_comparison_keeps_later_separator(spark):
    df = spark.createDataFrame([("a_vs_b_vs_c",), ("right_vs_left",)], "c string")
    r, l = split_comparison("c")
    rows = df.select(r.alias("r"), l.alias("l")).collect()
    assert (rows[0].r, rows[0].l) == ("a", "b_vs_c")
    assert (rows[1].r, rows[1].l) == ("right", "left")
