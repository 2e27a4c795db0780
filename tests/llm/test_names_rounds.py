"""Rounds of name matching go on until one links nothing."""

from tripleloom.llm import names


def test_rounds_end_only_without_links(spark, monkeypatch):
    monkeypatch.setattr(names, "MAX_ROUNDS", 1, raising=False)  # a bound would stop after the first round
    df = spark.createDataFrame([(x, "person") for x in ["Korvapel Zintamudo", "Korvpel Zintamudo", "Korvapel Zintamdo", "Korvpel Zintmdo"]], "id string, kind string")
    forms = spark.createDataFrame([("Jon", "John")], "short_form string, full_form string")
    assert names.same_names(df, forms).count() == 6


def test_plans_do_not_grow_with_rounds(spark, monkeypatch):
    scans, write = [], names.materialise

    def note(df, label="step"):
        if label == "matches":
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df, label)

    monkeypatch.setattr(names, "materialise", note)
    words = ["Korvapel", "Korvpel", "Korvpl", "Krvpl"]
    ids = [f"{a} {b}" for a, b in zip(words, ["Zintamudo", "Zintamdo", "Zintmdo", "Zntmdo"], strict=True)] + ["Korvpel Zintamudo", "Korvpl Zintamdo", "Krvpl Zintmdo"]
    df = spark.createDataFrame([(x, "person") for x in ids], "id string, kind string")
    names.same_names(df, spark.createDataFrame([("Jon", "John")], "short_form string, full_form string")).count()
    assert len(scans) >= 2
    assert max(scans[1:]) <= scans[0]
