"""Letters of other scripts with the same shape, by the table of confusables."""

import pytest
from pyspark.sql import functions as F

from boughline.llm.visual import look_alike_classes, rules, shapes, visual_form
from boughline.schema import build

ALIKE = [("α", "a"), ("ι", "i"), ("σ", "o"), ("γ", "y"), ("κ", "к"), ("Ꭵ", "i"), ("ꮯ", "c"), ("𐐄", "O"), ("ց", "g"), ("յ", "ȷ"), ("Ⲕ", "K"), ("І", "I"), ("ӏ", "l"), ("カ", "力")]
APART = [("ı", "i"), ("ł", "l"), ("я", "r"), ("l", "I"), ("O", "0"), ("m", "rn"), ("ж", "x"), ("日", "曰")]


def forms(spark, texts):
    return [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(visual_form(F.col("t")).alias("f")).collect()]


@pytest.mark.parametrize(("pairs", "same"), [(ALIKE, True), (APART, False)])
def test_shapes(spark, pairs, same):
    got = forms(spark, [c for pair in pairs for c in pair])
    assert [p for p, a, b in zip(pairs, got[::2], got[1::2], strict=True) if (a == b) != same] == []


def test_mapped_letters_are_their_own_form(spark):
    known = rules(shapes(spark))
    assert len(known.one) > 3000 and all(known.one.get(to, to) == to for to in known.one.values())


def test_classes_of_look_alikes(spark):
    df = build(spark, [{"seq": i, "path": n} for i, n in enumerate(["cat", "сat", "ｃat", "dog", "x"])] + [{"seq": 9, "path": "l", "file_type": "l", "link_target": "dоg"}])
    got = {(r["seq"], r["representative"], r["link"]) for r in look_alike_classes(df).collect()}
    assert got == {(0, 0, False), (1, 0, False), (2, 0, False), (3, 3, False), (9, 3, True)}
