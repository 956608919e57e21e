import os

import pytest
from pyarrow import fs

from auditloom.sources import tree


def test_files_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [("a/b/c.sol", "contract C {}"), ("top.sol", "é\n"), ("a/empty.sol", ""), ("a/none.sol", None), (None, "x"), ("../up.sol", "x"), ("/abs.sol", "x"), ("a//b.sol", "x"), ("same.sol", "one"), ("same.sol", "one")]
    manifest = tree.emit(spark.createDataFrame(rows, tree.SCHEMA).repartition(3), folder)
    assert {(r.status, r.files, r.bytes) for r in tree.statuses(manifest).collect()} == {("written", 5, 13 + 3 + 0 + 3 + 3), ("empty", 1, 0), ("refused", 4, 0)}
    assert {(r.path, r.content) for r in tree.read_back(manifest, folder).collect()} == {("a/b/c.sol", "contract C {}"), ("top.sol", "é\n"), ("a/empty.sol", ""), ("same.sol", "one")}
    assert not os.path.exists(f"{tmp_path}/up.sol") and open(f"{tmp_path}/out/a/b/c.sol").read() == "contract C {}"
    with open(f"{tmp_path}/out/stray.sol", "w") as f:  # what no task that Spark took has written
        f.write("lost")
    assert tree.read_back(manifest, folder).where("path = 'stray.sol'").count() == 0
    assert tree.emit(spark.createDataFrame([], tree.SCHEMA), folder).count() == 0


def test_a_lost_task_is_in_no_list(tmp_path):
    folder = f"file://{tmp_path}"
    writer = tree.TreeWriter({"path": folder, "job": "j"})
    row = lambda p: type("R", (), {"path": p, "content": p})()
    kept, lost = writer.write(iter([row("a/x"), row("y")])), writer.write(iter([row("z")]))
    writer.commit([kept])
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/_committed-j") as f:
        assert f.read().decode().split() == [kept.part] and lost.part != kept.part
    writer.abort([kept, None, lost])
    assert not os.path.exists(f"{tmp_path}/{kept.part}")


@pytest.mark.parametrize("path,bad", [("a/b", False), ("a.sol", False), ("", True), (None, True), ("/a", True), ("a/../b", True), ("./a", True), ("a/", True)])
def test_refused(path, bad):
    assert tree.refused(path) == bad
