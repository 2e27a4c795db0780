"""Words of names: misspelt twins of common words, fillers run together with rare words."""

from tests.llm.test_names_rematch import pairs
from tripleloom.llm.names import Lexicon


def test_a_misspelt_twin_stands_for_what_the_twin_stands_for():
    lexicon = Lexicon({"linkage": 800, "lineage": 100, "store": 500}, {})
    assert lexicon.word("lineage") == lexicon.word("lineauge") == lexicon.word("linkage") == "linkage"
    assert lexicon.word("stor") == "store" and lexicon.word("lamp") == "lamp"


def test_fillers_run_together_with_rare_words(spark):
    same = ["Zintamudo Korvapel for Gonbaldu Valtodil", "ZintamudoKorvapelforGonbalduValtodil", "zkgv"]
    alone = ["Anna Hollamuand", "Anna Hollamu"]  # two words: the ending belongs to the name
    want = {(a, b) for a in same for b in same if a < b}
    assert pairs(spark, same + alone) == want
