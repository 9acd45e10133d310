import json
import os

import pytest

from quirelake import cli
from quirelake.engine import ChecksumNotFound
from quirelake.operators import translate
from quirelake.project import Project, chunks_of
from quirelake.sources import config as settings

NOTEBOOK = {"cells": [{"cell_type": "markdown", "metadata": {}, "source": ["# Title\n", "Hello *you*."]}, {"cell_type": "code", "metadata": {}, "source": "x = 1", "outputs": [], "execution_count": None}], "metadata": {"kernelspec": {"name": "python3"}}, "nbformat": 4, "nbformat_minor": 5}
FILES = {
    "a/one.tex": "\\section{Start}\n\nThe first text with $x$.\n\nAnother paragraph.\n",
    "two.md": "# Head\n\nA paragraph of \"Markdown\".\n\n# Next\n\nMore words.\n",
    "three.typ": "= Title\nSome words here\n\n= Other\nlast words",
    "four.ipynb": json.dumps(NOTEBOOK),
    "five.txt": "plain line\n" * 60,
}


@pytest.fixture
def project(spark, tmp_path, monkeypatch):
    for name, content in {**{f"src/{k}": v for k, v in FILES.items()}, "src/img/pic.png": "bits"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    c = settings.ProjectConfig("p")
    c.set_source("src", "English")
    c.add_target("French")
    c.add_target("German")
    for name in FILES:
        c.add_file(f"src/{name}")
    settings.save(c, str(tmp_path / settings.FILE_NAME))
    monkeypatch.chdir(tmp_path)
    return Project(spark, str(tmp_path))


def read(project, language, name):
    with open(os.path.join(project.root, f"p_{language}", name), encoding="utf-8") as file:
        return file.read()


def test_every_type_is_translated_and_a_second_run_hits(project):
    told = []
    rows = project.translate(on_file=told.append)
    assert len(rows) == 10 and told == rows and all(r["failed"] == 0 and r["translated"] > 0 for r in rows)
    one, two, three = (read(project, "fr", n) for n in ("a/one.tex", "two.md", "three.typ"))
    assert one.startswith("% CHUNK_METADATA_START\n% src_checksum: ") and "% needs_review: True\n% translation_service: echo\n" in one and "[French] " in one and "$x$" in one
    assert two.count("<!--") == two.count("[French] ") == 2 and three.count("// CHUNK_METADATA_END\n") == 2 and "[French] " in three
    cells = json.loads(read(project, "de", "four.ipynb"))
    assert cells["metadata"] == NOTEBOOK["metadata"] and "[German]" in cells["cells"][0]["source"] and cells["cells"][1]["source"] == "x = 1" and cells["cells"][0]["metadata"]["needs_review"] == "True"
    assert read(project, "fr", "five.txt").count("plain line") == 60
    again = project.translate("French")
    assert all(r["translated"] == 0 and r["from_cache"] > 0 for r in again)
    # what the target said of its chunks is kept
    assert read(project, "fr", "a/one.tex") == one and read(project, "fr", "two.md") == two
    status = {(r.lang, r.rel_path): (r.total, r.translated, r.needs_review) for r in project.status().collect()}
    assert len(status) == 10 and status["French", "two.md"] == (2, 2, 2)


def test_edits_are_recorded_and_survive(project):
    project.translate("French", ["src/two.md"])
    path = os.path.join(project.root, "p_fr/two.md")
    edited = read(project, "fr", "two.md").replace("More words.", "Mehr.").replace("needs_review: True", "needs_review: False")
    with open(path, "w", encoding="utf-8") as file:
        file.write(edited)
    with pytest.warns(UserWarning):
        assert project.correct("French") == 1
    project.translate("French", ["src/two.md"])
    text = read(project, "fr", "two.md")
    assert "Mehr." in text and "needs_review: False" in text and "needs_review: True" not in text
    with pytest.warns(UserWarning):
        project.cache_sync("French")
    assert project.translate("French", ["src/two.md"])[0]["from_cache"] == 2
    lost = project.spark.createDataFrame([("p", "English", "French", "nothing", "x")], "path_hash string, src_lang string, tgt_lang string, src_checksum string, tgt_text string")
    with pytest.raises(ChecksumNotFound):
        project.engine.record(lost)


def test_a_fatal_failure_ends_the_run_but_keeps_its_work(project, tmp_path):
    folder = tmp_path / ".quirelake/services"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "template.py").write_text("raise SystemError")
    (folder / "dead.py").write_text("from quirelake.operators.translate import Fatal\ndef model(request):\n    raise Fatal('no key')\n")
    (folder / "broken.py").write_text("nonsense(")
    (folder / "echo.py").write_text("model = None")
    project.config.llm_service = "dead"
    settings.save(project.config, str(tmp_path / settings.FILE_NAME))
    with pytest.warns(UserWarning):
        again = Project(project.spark, project.root)
    assert again.services == ["dead"] and "dead" in translate.custom_services()
    with pytest.raises(translate.RunAborted):
        again.translate("French", ["src/two.md"])
    text = read(project, "fr", "two.md")
    assert text.count("not-translated-due-to-exception: True") == 2 and "[French]" not in text
    runs = project.spark.read.parquet(os.path.join(project.root, ".quirelake/runs/*"))
    assert {r.outcome for r in runs.collect()} <= {"failed", "untried"}


def test_parser_settings_reach_the_model(project):
    project.config.latex_placeholder_commands = ["emph"]
    request = project.caller().translate("See \\emph{this one} now.", "latex", "English", "French")
    assert request[1].count("this one") == 1
    xml, placeholders, _ = translate.tag(translate.segments_of("latex", "See \\emph{this one} now.", project.settings()))
    assert "\\emph{this one}" in placeholders.values()


def test_commands(project, capsys):
    assert cli.main(["translate", "--all", "--to", "French"]) == 0 and "two.md -> French" in capsys.readouterr().out
    assert cli.main(["translate"]) == 1 and cli.main(["translate", "--all", "src/two.md"]) == 1
    assert cli.main(["sync", "--to", "French"]) == 0 and os.path.exists(os.path.join(project.root, "p_fr/img/pic.png"))
    assert cli.main(["status", "--files"]) == 0 and "2/2 translated" in capsys.readouterr().out
    assert cli.main(["cache", "sync", "--to", "French"]) == 0
    checksum = project.engine.pairs().first()["src_checksum"]
    assert cli.main(["cache", "clear", "--checksum", checksum]) == 0
    assert project.engine.pairs().where(f"src_checksum = '{checksum}'").count() == 0
    assert cli.main(["cache", "clear", "--all", "--file", "src/two.md"]) == 0 and cli.main(["cache", "clear", "--all", "--checksum", "x"]) == 1
    assert cli.main(["llm", "list"]) == 0 and cli.main(["latex", "cmd-spec", "set", "foo", "2"]) == 0
    assert settings.load(settings.FILE_NAME).latex_command_specs == {"foo": {"mandatory": 2, "optional": 0}}
    assert [r.rel_path for r in project.extra_files("French").collect()] == []


def test_jupytext_markdown_is_a_notebook():
    text = "---\njupytext:\n  text_representation:\n    extension: .md\n    format_name: myst\n---\n\n# A\n\n```{code-cell} python\n:tags: [x]\nx = 1\n```\n\nB\n+++\nC\n"
    assert chunks_of("markdown", text) == [("myst", "# A"), ("code", "x = 1"), ("myst", "B"), ("myst", "C")]
    assert chunks_of("other", "") == [] and [k for k, _ in chunks_of("jupyter", json.dumps(NOTEBOOK))] == ["myst", "code"]


def test_unknown_strategy():
    assert translate.strategy("markdown", "myst") == "tagged"
    with pytest.raises(KeyError):
        translate.strategy("latex", "code")
