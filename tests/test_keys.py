import regex
from pyspark.sql import functions as F

from tempolex.functions.keys import canonical_key, token_array, token_text

TEXTS = [None, "", "  ", "Plain ASCII, 12-b!", "co­operate zero​width", "Éclair ſtraße İx", "دفعہ ۳۰۲ قانون", "a_b c'd", "𝕊ec ⅳ", "x" * 100_000, "é decomposed"]


def tokens(text):
    text = (text or "").translate({0xAD: None, 0x200B: None, 0x2060: None, 0xFEFF: None}).lower()
    return regex.findall(r"[\p{L}\p{N}]+", text)


def test_tokens_match_the_definition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", token_array(F.col("t")).alias("w"), token_text(F.col("t")).alias("j")).collect():
        assert r.w == tokens(r.t)
        assert r.j == " ".join(tokens(r.t))


def test_canonical_key(spark):
    df = spark.createDataFrame([(" hrnc ", "Section ", "۳۰۲-b"), ("X", "Rule", " 1 0 "), (None, None, None)], "statute string, unit string, number string")
    assert [tuple(r) for r in df.select(*canonical_key()).collect()] == [("HRNC", "section", "302B"), ("X", "rule", "10"), (None, None, None)]
