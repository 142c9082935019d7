"""Runs of names or digits as long as the longest documents: regular expressions must not take stack for each repetition."""

import re

from pyspark.sql import functions as F

from framegauge.llm import decontam

ITEM = "what must every careful reader of old maps know about the rivers of the north"


def test_long_runs_are_one_slot(spark):
    """A literal is folded in the driver's thread: an overflow fails the test and ends no executor."""
    for run, slot in (("Anna " * 20_000, decontam.NAME), ("1," * 20_000 + "1 ", decontam.NUMBER)):
        row = spark.range(1).select(F.to_json(decontam.template_tokens(F.lit(f"he saw {run}there"))).alias("t"), F.size(decontam.raw_tokens(F.lit(f"he saw {run}there"))).alias("n")).first()
        assert (row.t, row.n) == (f'["he","saw","{slot}","there"]', 4)


def test_items_are_found_beside_long_runs(spark):
    runs = ["Anna " * 20_000, "Anna\t" * 5_000 + "Bert ", "1.5," * 20_000 + "3 "]
    rows = [(i, f"then he saw {run}and asked {ITEM if i % 2 == 0 else 'nothing at all'} and left") for i, run in enumerate(runs + runs[::-1])]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, ITEM)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, 7), (2, 7), (4, 7)]


def test_slots_are_what_the_rule_says(spark):
    """Short runs against Python's greedy expressions, blanks and separators at every place among them."""
    texts = ["a Anna Bert  Carl Dora", "a Anna\tBert Carl. Dora Eva", "a AnnaBert Carl McDon x Éva Öl Z Zo", "1,2.3, 4 5.,6 7..8 9.", "a An1,2 Bo 3.4.5x 6,Anna"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontam.template_tokens(F.col("text")).alias("tokens")).collect()
    lower, upper = "[^\\W\\d_A-ZÉÖ]", "[A-ZÉÖ]"
    for r in rows:
        plain = re.sub(f"(?<=[^.!?:\\s][ \\t]){upper}{lower}+(?:[ \\t]{upper}{lower}+)*", decontam.NAME, r.text)
        plain = re.sub("[0-9]+(?:[.,][0-9]+)*", decontam.NUMBER, plain).lower()
        assert r.tokens == re.split("[ \t]+", re.sub("[!-/:-@\\[-`{-~]+", "", plain).strip(" \t")), r.text
