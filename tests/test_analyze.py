import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomewise import Options, analyze, from_dir, from_files, from_table, json_schema, options_schema, python_tokenizer
from tomewise.__main__ import run
from tomewise.functions import yaml12
from tomewise.functions.markdown import scan
from tomewise.operators import frontmatter, manifest, references
from tomewise.plans import render
from tomewise.plans.analyze import OUTPUT
from tomewise.plans.schema import faults
from tomewise.sources.trees import inside
from tomewise.streaming.ingest import ingest


def skill(front, body="# T\n"):
    return f"---\n{front}\n---\n{body}"


MINIMAL = skill("name: test-skill\ndescription: A minimal skill")
TREES = {
    "minimal": ({"SKILL.md": MINIMAL}, None, {"version-missing", "readme-missing", "license-missing"}),
    "empty": ({"a.txt": "x"}, None, {"no-skill-md", "orphan-file", "readme-missing", "license-missing"}),
    "bad-yaml": ({"SKILL.md": "---\n: : this is invalid yaml : :\n---\n\nBody."}, None, {"frontmatter-parse", "readme-missing", "license-missing"}),
    "no-fence": ({"SKILL.md": "# Just Markdown\n"}, None, {"name-missing", "description-missing", "version-missing", "readme-missing", "license-missing"}),
    "names": ({"SKILL.md": skill("name: bad_name\ndescription: d\nmetadata: {version: '1'}\nlicense: MIT"), "README.md": "x"}, "skill-b", {"name-invalid", "name-dir-mismatch", "license-file-missing"}),
    "long": ({"SKILL.md": skill(f"name: {'a' * 65}\ndescription: {'b' * 1025}\ncompatibility: {'c' * 501}\nmetadata: {{version: 1.10, n: [1]}}", "x" * 16001), "README.md": "x", "COPYING": "MIT License"}, None, {"name-too-long", "description-too-long", "compatibility-too-long", "metadata-non-string", "body-too-long"}),
    "lines": ({"SKILL.md": skill("name: ok\ndescription: d\nversion: '2'\nallowed-tools: A B", "\n" * 501), "README.md": "", "LICENSE": ""}, None, {"body-too-many-lines", "allowed-tools-experimental"}),
    "refs": ({"SKILL.md": skill("name: ok\ndescription: d\nversion: '2'", "[a](references/none.md) [b](../shared/SKILL.md) `scripts/run.py`\n"), "README.md": "", "LICENSE": "", "scripts/run.py": "import x", "assets/lost.txt": "", "big.bin": b"\xff" * 500}, None, {"broken-ref", "external-ref", "orphan-file", "file-too-large"}),
}


def test_each_tree_gives_its_codes(spark):
    files = None
    for name, (tree, folder, _) in TREES.items():
        one = from_files(spark, tree, folder, name)
        files = one if files is None else files.unionByName(one)
    found = {r.skill_id: r for r in analyze(files).collect()}
    codes = lambda n: {d.code for d in found[n].diagnostics}
    for name, (_, _, want) in TREES.items():
        assert codes(name) == want - {"file-too-large"}, name
    assert not found["empty"].ok and found["minimal"].ok and found["empty"].body is None
    assert found["long"].frontmatter.version == "1.1" and found["refs"].references.orphans == ["assets/lost.txt", "big.bin"]
    assert [f.isText for f in found["refs"].files if f.path == "big.bin"] == [False]


def test_options(spark):
    tree = {"SKILL.md": skill("name: default\ndescription: d"), "references/large.md": "x" * 500, ".git/config": "x"}
    row = analyze(from_files(spark, tree), Options(max_file_bytes=200, rules={"name-reserved": "error", "version-missing": "off"}, ignore=[], tokenizer=("chars", F.length))).first()
    assert not row.ok and {"name-reserved", "file-too-large", "orphan-file"} <= {d.code for d in row.diagnostics} and "version-missing" not in {d.code for d in row.diagnostics}
    assert [f.path for f in row.files] == [".git/config", "SKILL.md"] and row.tokens.tokenizer == "chars" and row.tokens.metadata == len("default d")
    for bad in ({"max_file_bytes": 0}, {"rules": {"a": "loud"}}, {"ignore": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)


#: body, paths, texts, folder, YAML block, orphans
GRAPHS = [
    ("[t](templates/) [x](.) [a](./a.md#s) [b](a/../b.md)", ["templates/x.md", "a.md", "b.md"], {}, None, None, ["b.md"]),
    ("`./fonts`", ["fonts/a.ttf"], {}, None, None, []),
    ("fonts", ["fonts/a.ttf"], {}, None, None, ["fonts/a.ttf"]),
    ("data.md", ["a.md"], {}, None, None, ["a.md"]),
    ("guide.md", ["x/guide.md"], {}, None, None, []),
    ("guide.md", ["x/guide.md", "y/guide.md"], {}, None, None, ["x/guide.md", "y/guide.md"]),
    ("see a.md now", ["a.md", "b.md", "c.py"], {"a.md": "to b.md\n", "b.md": "c.py a.md"}, None, None, []),
    ("nothing", ["a.md", "b.md"], {"a.md": "b.md"}, None, None, ["a.md", "b.md"]),
    ("python -m scripts.run", ["scripts/run.py", "scripts/__init__.py", "scripts/u.py"], {"scripts/run.py": "from .u import x"}, None, None, []),
    ("scripts/office/pack.py", ["scripts/office/pack.py", "scripts/office/val/__init__.py"], {"scripts/office/pack.py": "from val import V"}, None, None, []),
    ("require('./scripts/utils')", ["scripts/utils.js"], {}, None, None, []),
    ("scripts/utils", ["scripts/utils.js", "scripts/utils.ts"], {}, None, None, ["scripts/utils.js", "scripts/utils.ts"]),
    ('"$SCRIPT_DIR/utils.sh" "$(dirname "$0")/c.sh" {base}/s/x.sh', ["utils.sh", "c.sh", "s/x.sh"], {}, None, None, []),
    ("/mnt/skills/data/scripts/a.py", ["scripts/a.py"], {}, "data", None, []),
    ("/mnt/skills/data/scripts/a.py", ["scripts/a.py"], {}, "other", None, ["scripts/a.py"]),
    ("x", ["scripts/check.ps1"], {}, None, 'command: "${DIR}/scripts/check.ps1"', []),
    ("`my file.md`", ["my file.md"], {}, None, None, []),
    ("See my file.md now", ["my file.md"], {}, None, None, []),
    ("See guide.md.", ["guide.md"], {}, None, None, ["guide.md"]),
    ("a/b/c.md", ["a/b/c.md", "a/d.md", "a/e/f.md", "g.py", "a/b.js"], {"a/b/c.md": "../d.md ../e/f.md ../../g.py"}, None, None, ["a/b.js"]),
    ("a/b/c.py", ["a/b/c.py", "a/d.py", "a/b/e.py", "a/b/f/g.py", "h.py"], {"a/b/c.py": "from ..d import x\nfrom .e import y\nfrom f.g import z\nfrom ...h import q"}, None, None, []),
    ("a/b/c.md", ["a/b/c.md", "a/p/x.bin", "a/b/q/y.bin", "z/w.bin"], {"a/b/c.md": "see ../p/ and ./q and ../../z/"}, None, None, []),
    ("a/b/c.md", ["a/b/c.md", "a/b/y.bin"], {"a/b/c.md": "see ./ and a/b/"}, None, None, ["a/b/y.bin"]),
    ("Wörter/dé.md", ["Wörter/dé.md", "Wörter/x y.md", "ö/z.bin"], {"Wörter/dé.md": "see x y.md, ../ö/ "}, None, None, []),
]


def tree(body, texts, paths, block):
    return {"SKILL.md": (f"---\n{block}\n---\n" if block else "") + body, **{p: texts.get(p, b"\xff") for p in paths}}


def corpus(spark, trees):
    """trees: skill_id -> (folder, files)."""
    rows = [(k, folder, p, bytearray(c.encode("utf-8", "surrogatepass") if isinstance(c, str) else c)) for k, (folder, files) in trees.items() for p, c in files.items()]
    return spark.createDataFrame(rows, "skill_id string, dir string, path string, content binary")


def test_reference_graph(spark, monkeypatch):
    trees = {str(i): (folder, tree(body, texts, paths, block)) for i, (body, paths, texts, folder, block, _) in enumerate(GRAPHS)}
    got = {int(r.skill_id): r.references for r in analyze(corpus(spark, trees), columns=("references",)).collect()}
    for i, case in enumerate(GRAPHS):
        assert got[i].orphans == case[5], case
    assert got[0].resolved == ["./a.md#s", "a/../b.md", "templates/"] and got[0].broken == ["."]


def test_closure_over_many_blocks(spark):
    import random

    from tomewise.functions.store import table_store

    r = random.Random(2)
    edges = {(s, f"n{a}", f"n{b}") for s in "xy" for a, b in [(i, i + 1) for i in range(60)] + [(r.randrange(200), r.randrange(200)) for _ in range(80)]}
    want, todo = set(), [("x", "n0"), ("y", "n150")]
    while todo:
        at = todo.pop()
        if at not in want:
            want.add(at)
            todo += [(s, b) for s, a, b in edges if (s, a) == at]
    found = references.reachable(spark.createDataFrame(sorted(edges), "skill_id string, src string, dst string"), spark.createDataFrame([("x", "n0"), ("y", "n150"), ("z", "n1")], "skill_id string, path string"), table_store(spark), most=60)
    assert sorted(map(tuple, found.collect())) == sorted({*want, ("z", "n1")})


BAD = {
    "surrogates": 'name: "\\ud800"\ndescription: d\nx: "\\udfff"\nmetadata: {"\\ud800": 1}\nallowed-tools: ["\\ud800"]', "large": "name: a\nx: " + "1" * 400, "larger": "name: a\nx: -" + "9" * 5000,
    "tab": "name:\ta\tb", "null-key": "~: v\nname: a", "clash": "1: a\n'1': b\nname: a", "set": "a: !!set {x, y}\nname: a", "binary": "a: !!binary aGk=\nname: a", "cycle": "a: &x\n  b: *x\nname: a",
    "deep": "a: " + "[" * 3000, "bomb": "a: &a [x,x,x,x,x,x,x,x,x]\n" + "".join(f"{c}: &{c} [{','.join(['*' + p] * 9)}]\n" for p, c in zip("abcdefg", "bcdefgh")), "good": "name: good\ndescription: d",
}


def test_one_bad_file_ends_nothing(spark):
    found = analyze(corpus(spark, {k: (k, {"SKILL.md": skill(v), "\u00e9\ufffd \U0001f600.md": "\ufeffx"}) for k, v in BAD.items()})).collect()
    got = {r.skill_id: r for r in found}
    assert got.keys() == BAD.keys() and got["good"].ok
    failed = {k for k, r in got.items() if any(d.code == "frontmatter-parse" for d in r.diagnostics)}
    assert failed == {"deep", "bomb"}
    assert got["surrogates"].frontmatter.name == "\ufffd" and got["large"].frontmatter.extra == got["larger"].frontmatter.extra == '{"x":null}'
    assert got["tab"].frontmatter.name == "a\tb" and got["null-key"].frontmatter.extra == '{"":"v"}' and got["clash"].frontmatter.extra == '{"1":"b"}'
    assert got["set"].frontmatter.extra == '{"a":{}}' and got["binary"].frontmatter.extra == '{"a":{"0":104,"1":105}}' and got["cycle"].frontmatter.extra == '{"a":{"b":null}}'
    for r in found:
        assert not faults(json.loads(render.to_json(r)), json_schema()) and render.to_text(r)


def test_sinks():
    line = render.diagnostic_line({"code": "c", "severity": "error", "message": "m", "field": "f", "hint": "h"})
    assert line == "✗ error   c [f] — m\n        hint: h"
    assert render.diagnostic_line({"code": "c", "severity": "warning", "message": "m"}, True) == "\x1b[33m⚠ warning\x1b[0m c — m"
    assert yaml12.json_pretty({"b": [1e-7, 1e21, {}], "10": [], "2": {"x": None}}) == '{\n  "2": {\n    "x": null\n  },\n  "10": [],\n  "b": [\n    1e-7,\n    1e+21,\n    {}\n  ]\n}'


def test_schemas():
    assert not faults({"ignore": ["a"], "max_file_bytes": 1, "rules": {"a": "off"}}, options_schema()) and faults({"rules": {"a": "loud"}}, options_schema()) and faults({"x": 1}, options_schema())
    assert set(json_schema()["required"]) == set(OUTPUT) and faults({}, json_schema())


def test_tables_streams_and_python_tokenizers(spark, tmp_path):
    table = spark.createDataFrame([("s", "SKILL.md", MINIMAL), ("s", "a.md", "x")], "skill_id string, path string, content string")
    row = analyze(from_table(table), Options(tokenizer=python_tokenizer("words", lambda t: len(t.split())))).first()
    assert row.dir is None and row.tokens.tokenizer == "words" and row.tokens.metadata == 4 and [f.path for f in row.files] == ["SKILL.md", "a.md"]
    files = corpus(spark, {"a": ("a", {"SKILL.md": MINIMAL}), "b": ("b", {"SKILL.md": MINIMAL + "more"})})
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(2):
        (files if step else files.where("skill_id = 'a'")).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(files.schema).parquet(source), out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.skill_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_paths_cannot_leave_their_root(tmp_path):
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            inside(str(tmp_path), bad)
    assert inside(str(tmp_path), "a/../b") == str(tmp_path / "b")


def test_markdown():
    t = "```\nx\n```\t\n#x\n# A #\n ```\n# no\n ```\n~~~ py\n# no\n    ~~~\n# no\n~~~\n## B\n`a` ``b`c`` `[l](no.md)` ![i](i.png) [t](g.md \"T\") [u](<a b.md>) [v](<>)\n```py title\n# C"
    assert scan(t) == {"headings": [(1, "A"), (2, "B"), (1, "C")], "link_targets": ["i.png", "g.md", "a b.md"], "inline_code": ["a", "b`c", "[l](no.md)"]}


def test_yaml_and_numbers():
    assert yaml12.load("a: 014\nb: yes\nc: 0x1F\nd: 1:30\n<<: x") == {"a": 14, "b": "yes", "c": 31, "d": "1:30", "<<": "x"}
    with pytest.raises(Exception, match="unique"):
        yaml12.load("a: 1\na: 2")
    assert yaml12.canonical_json({"b": float("nan"), "a": -0.0, "c": [1e21, 1e-7, 123456789012345680000, 0.1, 100]}) == '{"a":0,"b":null,"c":[1e+21,1e-7,123456789012345680000,0.1,100]}'
    assert yaml12.canonical_json(yaml12.load("a: &x\n  b: *x")) == '{"a":{"b":null}}'


def test_digest_of_the_example_and_of_nothing(spark):
    one = [("s", "b", "2"), ("s", "a", "1")]
    import hashlib

    assert manifest.digest(spark.createDataFrame(one, "skill_id string, path string, hash string")).first().digest == "sha256:" + hashlib.sha256(b"a\n1\nb\n2\n").hexdigest()
    assert analyze(from_files(spark, {})).first().digest.endswith("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_version_does_not_change_the_digest(spark):
    a, b = (analyze(from_files(spark, {"SKILL.md": skill(f"name: n\ndescription: d\nmetadata: {{version: '{v}'}}")})).first() for v in "12")
    assert a.digest == b.digest and a.frontmatter.version != b.frontmatter.version


def test_folder_and_command_line(spark, tmp_path):
    root = tmp_path / "demo"
    (root / "pkg").mkdir(parents=True)
    (root / "SKILL.md").write_text(MINIMAL)
    (root / "pkg" / "__init__.py").write_text("")
    (root / ".hidden").write_bytes(b"\xff")
    (root / "link").symlink_to(root / "SKILL.md")
    row = analyze(from_dir(spark, str(root))).first()
    assert [f.path for f in row.files] == [".hidden", "SKILL.md", "pkg/__init__.py"] and row.dir == "demo"
    said: list[str] = []
    assert run([], said.append, said.append) == 2 and run(["--no", "-h"], said.append, said.append) == 2 and run([str(tmp_path / "none")], said.append, said.append) == 2 and run(["--no"], said.append, said.append) == 2 and run([str(tmp_path)], said.append, said.append) == 2 and run(["-h"], said.append) == 0
    assert '"schemaVersion"' in render.to_json(row) and "Diagnostics" in render.to_text(row, True)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.text(alphabet="ab:-[]{}&*!|>'\"#%@` \n\t0.~", max_size=60))
def test_parsing_never_throws(text, block):
    for t in (text, f"---\n{block}\n---\n{text}"):
        out = frontmatter.parse(t)
        assert out["body"] is not None and isinstance(out["hash_text"], str)
