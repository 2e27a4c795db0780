import __spark_entry__ as entry


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tripleloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tripleloom.llm" not in f.read_text()
