import json
import os

from paperloom.sources import manifest

SCHEMA, STRUCT = "a string, n int", "a: string, n: int"


def put(folder, name, text, at):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text))
    os.utime(path, (at, at))


def state(spark, store):
    names = lambda rows: sorted((os.path.basename(r.path), *r[1:]) for r in rows.collect())
    return names(manifest.pages(spark, store, STRUCT)), names(manifest.rejects(spark, store, STRUCT))


def test_files_change_and_vanish(spark, tmp_path):
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    parse = manifest.json_page(SCHEMA)
    put(root, "1.json", {"a": "x", "n": 1}, 1000)
    put(f"{root}/deep", "2.json", {"a": "y"}, 1000)
    put(root, "3.json", '{"a": ', 1000)
    put(root, "4.json", " ", 1000)
    put(root, "0.json", "", 1000)  # not a file to Spark
    put(root, "note.txt", "no", 1000)
    run = lambda: manifest.ingest(spark, root, store, parse, "*.json")
    assert run() == {"read": 2, "rejected": 2, "touched": 0, "vanished": 0}
    assert state(spark, store) == ([("1.json", "x", 1), ("2.json", "y", None)], [("3.json", "no JSON object of this schema", '{"a": '), ("4.json", "empty", " ")])
    assert run() == {"read": 0, "rejected": 0, "touched": 0, "vanished": 0}
    put(root, "1.json", {"a": "x", "n": 1}, 2000)  # the same again
    put(f"{root}/deep", "2.json", {"a": "z", "n": 2}, 2000)
    put(root, "3.json", {"a": "mended"}, 2000)
    os.remove(f"{root}/4.json")
    put(root, "5.json", {"a": "x", "n": 1}, 2000)  # what another file says
    assert run() == {"read": 3, "rejected": 0, "touched": 1, "vanished": 1}
    want = [("1.json", "x", 1), ("2.json", "z", 2), ("3.json", "mended", None), ("5.json", "x", 1)]
    assert state(spark, store) == (want, [])
    put(root, "4.json", {"a": "back"}, 3000)
    assert run() == {"read": 1, "rejected": 0, "touched": 0, "vanished": 0}
    assert state(spark, store)[0] == sorted([*want, ("4.json", "back", None)])


def test_killed_runs_are_repeated(spark, tmp_path):
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(root, "1.json", {"a": "x"}, 1000)
    parse = manifest.json_page(SCHEMA)
    manifest.ingest(spark, root, store, parse)
    put(root, "2.json", {"a": "y"}, 1000)
    manifest.ingest(spark, root, store, parse)
    os.remove(f"{store}/commits/1")  # as if it had been killed before its end
    for name in os.listdir(f"{store}/commits"):
        if "crc" in name:
            os.remove(f"{store}/commits/{name}")
    assert manifest.runs(spark, store) == [0] and [p[0] for p in state(spark, store)[0]] == ["1.json"]
    assert manifest.ingest(spark, root, store, parse)["read"] == 1
    assert manifest.runs(spark, store) == [0, 1] and [p[0] for p in state(spark, store)[0]] == ["1.json", "2.json"]
    assert manifest.ingest(spark, root, store, parse) == {"read": 0, "rejected": 0, "touched": 0, "vanished": 0}
