import json

import pytest

from quirelake import cli
from quirelake.sources import config, correspondence, files


def test_scan_plan_copy_write(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a/b").mkdir(parents=True)
    (src / "a/x.tex").write_bytes(b"one\r\ntwo\r")
    (src / "a/b/y.md").write_text("é")
    (src / "z.txt").write_text("z")
    scanned = {r.rel_path: (r.doc_type, r.text) for r in files.scan_texts(spark, str(src)).collect()}
    assert scanned == {"a/x.tex": ("latex", "one\ntwo\n"), "a/b/y.md": ("markdown", "é"), "z.txt": ("other", "z")}
    listed = files.list_files(spark, str(src))
    plan = files.copy_plan(listed, spark.createDataFrame([("a/b",)], "path string"))
    assert {r.rel_path for r in plan.collect()} == {"a/x.tex", "z.txt"}
    assert files.copy_files(plan, str(src), str(tmp_path / "out")) == 2 and (tmp_path / "out/z.txt").exists()
    extra = files.extra_files(listed, plan)
    assert [r.rel_path for r in extra.collect()] == ["a/b/y.md"]
    parts = spark.createDataFrame([("d/t.md", 2, "b"), ("d/t.md", 1, "a\n")], "rel_path string, part int, text string")
    assert files.write_documents(parts, str(tmp_path / "made")) == 1 and (tmp_path / "made/d/t.md").read_text() == "a\nb"
    assert files.nearest_upwards(str(src / "a/b"), "z.txt").endswith("src/z.txt") and files.nearest_upwards(str(src), "none") is None


def test_correspondence_csv(spark, tmp_path):
    wide = spark.createDataFrame([("p", "e", "")], "path_checksum string, English string, French string")
    correspondence.write_csv(wide, str(tmp_path / "c"), ["English", "French", "German"])
    back = correspondence.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["ord", "path_checksum", "English", "French", "German"] and back.first()["German"] == ""
    (tmp_path / "v.csv").write_text("English,French\na,b\n")
    assert [(r.src, r.tgt) for r in correspondence.read_vocabulary(spark, str(tmp_path / "v.csv"), "English", "French").collect()] == [("a", "b")]
    assert correspondence.read_vocabulary(spark, str(tmp_path / "v.csv"), "English", "Xx").count() == 0
    # of several files the later one's rows are the later ones, whatever their size
    for name, rows in (("a.csv", "p,x\n" * 3), ("b.csv", "p,y\n")):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / name).write_text("path_checksum,English\n" + rows)
    ordered = correspondence.read_csv(spark, str(tmp_path / "many")).orderBy("ord").collect()
    assert [r.English for r in ordered] == ["x", "x", "x", "y"]


def test_config_round_trip(tmp_path):
    c = config.ProjectConfig("p")
    c.set_source("src/", "english")
    c.add_language("Klingon", "_kl", "kl")
    assert c.add_target("KL").path == "p_kl" and c.add_target("fr" if False else "French").path == "p_fr"
    c.add_file("src/a.tex")
    c.add_file("src/d/b.tex")
    c.set_command_args("\\box", [2, 1, 2])
    c.set_typst_args("fig", [" Alt "])
    c.add_name("latex_math_envs", "mine")
    path = str(tmp_path / "c.toml")
    config.save(c, path)
    assert config.load(path) == c
    assert c.expand(["src/d", "src/a.tex"]) == ["src/d/b.tex", "src/a.tex"] and c.latex_command_args["box"]["mandatory"] == [1, 2]
    for bad in (lambda: c.add_language("klingon", "_x"), lambda: c.add_language("A", "x"), lambda: c.add_target("French"), lambda: c.add_file("other/a"), lambda: c.set_source("p_fr", "English"), lambda: c.remove_language("Klingon"), lambda: c.expand(["nope"]), lambda: c.set_command_args("a", [0]), lambda: c.remove_file("src/zz"), lambda: c.language("none")):
        with pytest.raises(config.ConfigError):
            bad()
    c.remove_target("Klingon")
    c.remove_language("Klingon")
    c.reasoning_service, c.reasoning_model = "s", "m"
    assert c.routed() == (("echo", "echo"), ("s", "m")) and c.routed(True) == (("s", "m"), None)


def test_env_and_keys():
    env = config.parse_env("# c\nA=1\nB = 'x y'\nC=\"q\nA=2=3\n\nbad\n")
    assert env == {"A": "2=3", "B": "x y", "C": '"q'}
    assert config.resolve_keys({"LLM_API_KEY": "s"}, {"LLM_API_KEY": "f"}) == ("s", "s")
    assert config.resolve_keys({}, {"LLM_API_KEY": "f", "LLM_REASONING_API_KEY": "r"}) == ("f", "r") and config.resolve_keys({}, {}) == (None, None)


def test_clearing_by_command(spark, tmp_path, capsys):
    from quirelake.engine import Engine

    engine = Engine(spark, str(tmp_path))
    engine.persist(spark.createDataFrame([("p", "en", "fr", "a", "A")], "path_hash string, src_lang string, tgt_lang string, src_text string, tgt_text string"))
    assert cli.main(["cache", "clear", str(tmp_path)]) == 1 and cli.main(["cache", "clear", str(tmp_path), "--missing-chunks", "--lang", "fr"]) == 1
    assert cli.main(["cache", "clear", str(tmp_path), "--missing-chunks"]) == 0 and engine.pairs().count() == 1
    assert cli.main(["cache", "clear", str(tmp_path), "--all", "--keyword", "A"]) == 0 and engine.pairs().count() == 0


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["info"]) == 1
    assert cli.main(["init", "p"]) == 0 and cli.main(["init", "p"]) == 1
    for line in ("source add src --lang English", "target add French", "lang add Klingon --suffix _kl --short kl", "file add src/a.tex", "llm set s m", "llm set-xml-retries 1", "vocab set v.csv", "typst set-func-args f a b", "latex math-env add mine", "latex cmd-args set box 1 2"):
        assert cli.main(line.split()) == 0, line
    c = config.load(config.FILE_NAME)
    assert (c.src_dir.path, c.llm_model, c.vocab_file, c.xml_retries_before_reasoning, c.latex_math_envs) == ("src", "m", "v.csv", 1, ["mine"])
    assert cli.main(["list"]) == 0 and "src/a.tex" in capsys.readouterr().out
    (tmp_path / "old.json").write_text(json.dumps({"name": "x", "unknown": 1}))
    assert cli.main(["migrate", "old.json"]) == 1 and cli.main(["migrate", "none.json"]) == 0
