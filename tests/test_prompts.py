"""Prompt banks from CSV (BOM, quotes, newlines, ragged lists) and the prompt grid."""

import os
import tempfile


from stancelab.operators import prompts as pr
from stancelab.sources.files import read_prompt_bank

BANK = (
    "﻿issue_no,prompt,keywords,endings,labels\n"
    '0,"Masks, gloves and ""shields""",a mask mandate , ,a mask requirement,"0, 2",good idea,bad idea\n'
)


def write_bank(text):
    d = tempfile.mkdtemp(prefix="bank-")
    p = os.path.join(d, "bank.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def fixture_bank():
    return (
        "﻿issue_no,prompt,keywords,endings,labels,topic_no,reverse_code\n"
        '0,"Masks, gloves and ""shields""","a mask mandate , ,a mask requirement","0, 2","good idea,bad idea",1,0\n'
        '1,"Line one\nline two",None,"1,9","safe",2,1\n'
        '2,Plain,"x, y","3","good, bad, safe ,dangerous",2,\n'
    )


def test_read_bank_traps(spark):
    bank = read_prompt_bank(spark, write_bank(fixture_bank()), "covid")
    rows = {r.issue_no: r for r in bank.collect()}
    assert bank.columns[0] == "dataset" and "issue_no" in bank.columns
    assert rows[0].prompt == 'Masks, gloves and "shields"'
    assert rows[0].keywords == "a mask mandate,a mask requirement" and rows[0].endings == "0,2"
    assert rows[1].prompt == "Line one\nline two" and rows[1].keywords == ""
    assert rows[2].labels == "good,bad,safe,dangerous" and rows[2].reverse_code is None


def test_missing_optional_columns(spark):
    text = "issue_no,prompt,keywords,endings,labels\n5,P,k,0,a\n"
    bank = read_prompt_bank(spark, write_bank(text), "validation").first()
    assert bank.topic_no is None and bank.reverse_code is None and bank.dataset == "validation"


def test_grid_counts_and_numbering(spark):
    raw = spark.createDataFrame([
        (0, "Q0?", "k1, k2", "0,2", "a,b"),
        (1, "Q1?", "None", "1, 9", "a"),         # missing keyword list; ending 9 has no template
        (2, "Q2?", "z", "3", "a,b,c,d"),
    ], "issue_no int, prompt string, keywords string, endings string, labels string")
    t = pr.templates_frame(spark)
    g = pr.prompt_grid(raw, t, pr.COVID_INTROS).orderBy("prompt_no").collect()
    # (2 endings x 2 keywords) + (1 known ending x 1 keyword-less) + (1 x 1) = 6 questions x 2 primes
    assert len(g) == 12
    assert [r.prompt_no for r in g] == list(range(12))
    assert [r.question_no for r in g] == [i // 2 for i in range(12)]
    assert g[0].keyword == "k1" and g[2].keyword == "k2" and g[0].partisanship == 0 and g[1].partisanship == 1
    assert g[0].ending == " My stance on k1 is that it is a"
    assert g[0].prompt == pr.COVID_INTROS[0] + " Q0?" + g[0].ending
    assert g[8].keyword is None and g[8].issue_no == 1
    unknown = [(r.issue_no, r.ending_id) for r in pr.unknown_templates(raw, t).collect()]
    assert unknown == [(1, 9)]


def test_axis_plan(spark):
    raw = spark.createDataFrame([(0, " good , bad ,x"), (1, "only"), (2, None)], "issue_no int, labels string")
    rows = {r.issue_no: r for r in pr.axis_plan(raw).collect()}
    assert (rows[0].positive_anchor, rows[0].negative_anchor, rows[0].labels) == ("good", "bad", "good,bad,x")
    assert (rows[1].positive_anchor, rows[1].negative_anchor) == ("only", "")
    assert (rows[2].positive_anchor, rows[2].labels) == ("", "")


def test_justification_prompt(spark):
    df = spark.createDataFrame([("P", "C"), ("P", None)], "p string, c string")
    got = [r[0] for r in df.select(pr.justification_prompt("p", "c")).collect()]
    assert got == ["P C. This is because", "P nan. This is because"]
