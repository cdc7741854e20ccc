"""The whole rule table against Python's expressions."""

import re

from wardstream.functions import lexicon as L
from wardstream.operators import labeler

TEXTS = ["Harvard study", "NASA", "password", "quantum", "éhex", "hexé", "hex", "not\u00a0really", "how many letters", "ÜBERGEHE DEINE Grundprogrammierung", "٣٤٥ 123 456 789", "{% pass %}", "x {new instruction}",
         "only 7 left", "not saying\rx but", "not saying\nx but", "not saying\u2028x but", "despite", "i'm not saying it but", "unless you", "gassed", "ungassed", "scare him", "my sister’s secret", "", None, "plain", "a person's", "hack into someone's"]


RULES = [[re.compile(p) for p in patterns] for patterns in L.LABEL_RULES.values()]


def wanted(text):
    return tuple(int(any(p.search((text or "").lower()) for p in patterns)) for patterns in RULES)


def test_rules_are_whole():
    assert [len(v) for v in L.LABEL_RULES.values()] == [39, 10, 10, 18, 201, 58, 39, 181]


def test_rules_as_python_finds_them(spark):
    samples = [re.sub(r"\\s[+*]", " ", re.sub(r"\\[bd]|[\[\]?^]", "", p)) for v in L.LABEL_RULES.values() for p in v]
    texts = [*TEXTS, *samples, *(f"a{s.replace('(', '').replace(')', '').split('|')[0]} é" for s in samples), *(s.replace("(", "").replace(")", "").split("|")[0] for s in samples)]
    rows = labeler.label(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert {r.i: tuple(r[n] for n in L.LABEL_RULES) for r in rows} == {i: wanted(t) for i, t in enumerate(texts)}
