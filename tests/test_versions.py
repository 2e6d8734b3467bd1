"""Contents by commit and guarded saves, on small tables."""

import pytest

from netloom.operators import versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_contents_are_stored_once(spark):
    files = [("a", "x.v", "module x; endmodule\n"), ("a", "y.v", "same"), ("b", "x.v", "module x; endmodule\n"), ("b", "z.v", "same"), ("b", "n.v", None), ("b", "../up.v", "no"), ("b", "/root.v", "no"), ("b", "a/../../up.v", "no"), ("b", "", "no")]
    tree, blobs = versions.stored(spark.createDataFrame(files, "commit string, path string, text string"))
    assert blobs.count() == 3 and tree.count() == 5
    # the ids are those of git hash-object
    assert {r["text"]: r["blob"] for r in blobs.collect()}[""] == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert rows(versions.as_of(tree, blobs, "b")) == [("n.v", ""), ("x.v", "module x; endmodule\n"), ("z.v", "same")]
    assert rows(versions.as_of(tree, blobs, "none")) == []
    assert rows(versions.changed_files(tree, "a", "b")) == [("n.v", "added"), ("y.v", "deleted"), ("z.v", "added")]


def test_saves_that_lose_or_add_names(spark):
    table = lambda r: spark.createDataFrame(r, "path string, module string, n int")
    old, new = table([("f", "a", 1), ("f", "b", 1), ("g", "c", 1), ("h", "d", 1), ("k", "e", 1)]), table([("f", "a", 2), ("g", "c", 2), ("g", "c2", 2), ("k", "e", 2), ("new", "z", 2)])
    saved = spark.createDataFrame([("f",), ("g",), ("h",), ("k",), ("new",)], "path string")
    by_module, by_file = (versions.save_decisions(old, new, saved, p) for p in ("module", "file"))
    assert [r[:4] for r in rows(by_module)] == [("f", ["b"], [], "kept"), ("g", [], ["c2"], "reloaded"), ("h", ["d"], [], "kept"), ("k", [], [], "replaced"), ("new", [], ["z"], "reloaded")]
    assert [r[3] for r in rows(by_file)] == ["reloaded", "reloaded", "reloaded", "replaced", "reloaded"]
    assert {r["path"]: r["warning"] for r in by_module.collect()}["h"] == "The file no longer defines d; its rows were left as they are."
    assert rows(versions.merged(old, new, by_module)) == [("f", "a", 1), ("f", "b", 1), ("g", "c", 2), ("g", "c2", 2), ("h", "d", 1), ("k", "e", 2), ("new", "z", 2)]
    assert rows(versions.merged(old, new, by_file)) == [("f", "a", 2), ("g", "c", 2), ("g", "c2", 2), ("k", "e", 2), ("new", "z", 2)]
    with pytest.raises(ValueError):
        versions.save_decisions(old, new, saved, "other")
