"""Names that only the merged profiles of earlier rounds make candidates."""

from tripleloom.llm import names


def pairs(spark, ids):
    df = spark.createDataFrame([(x, "person") for x in ids], "id string, kind string")
    forms = spark.createDataFrame([("Jon", "John"), ("Jim", "James")], "short_form string, full_form string")
    return {(r["id_a"], r["id_b"]) for r in names.same_names(df, forms).collect()}


def test_merged_profiles_block_again(spark):
    tie = ["John A. Gonbaldu", "James B. Gonbaldu", "J. A. Gonbaldu"]
    # the last is a letter from a family name of one spelling beside a given name of another
    joined = ["Korvapel Zintamudo", "Korvpel Zintamudo", "Korvapel Zintamdo", "Korvpel Zintmdo"]
    want = {("J. A. Gonbaldu", "John A. Gonbaldu")} | {(a, b) for a in joined for b in joined if a < b}
    open_ = ["John Pelvadomu", "James Pelvadomu", "J. C. Pelvadomu"]  # nothing tells which
    assert pairs(spark, tie + joined + open_) == want
