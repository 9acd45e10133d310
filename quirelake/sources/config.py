"""Project configuration, environment files and language rules; all of it on the driver."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields

from quirelake.functions.languages import SUFFIXES

#: name of a project's file; its keys, and the names of the keys' variables, are those of existing projects (fixed values)
FILE_NAME = "project.toml"


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


@dataclass
class LangDir:
    language: str
    path: str


@dataclass
class ProjectConfig:
    name: str
    lang_dirs: list[LangDir] = field(default_factory=list)
    src_dir: LangDir | None = None
    translatable_files: list[str] = field(default_factory=list)
    custom_languages: dict[str, str] = field(default_factory=dict)
    custom_language_shorts: dict[str, str] = field(default_factory=dict)
    env_file: str | None = None
    vocab_file: str | None = None
    llm_service: str = "echo"
    llm_model: str = "echo"
    reasoning_service: str | None = None
    reasoning_model: str | None = None
    xml_retries_before_reasoning: int = 2
    typst: dict[str, list[str]] = field(default_factory=lambda: {"ex": ["info"]})
    latex_placeholder_envs: list[str] = field(default_factory=list)
    latex_math_envs: list[str] = field(default_factory=list)
    latex_placeholder_commands: list[str] = field(default_factory=list)
    latex_command_args: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    latex_command_specs: dict[str, dict[str, int]] = field(default_factory=dict)

    # -- languages

    def language(self, name: str) -> str:
        """A language by name: predefined without regard to case, custom exactly, short without regard to case."""
        for known in SUFFIXES:
            if known.lower() == name.lower():
                return known
        if name in self.custom_languages:
            return name
        for short, known in self.custom_language_shorts.items():
            if short.lower() == name.lower():
                return known
        raise ConfigError(f"unknown language: {name}")

    def suffix(self, language: str) -> str:
        return SUFFIXES.get(language) or self.custom_languages[language]

    def add_language(self, name: str, suffix: str, short: str | None = None) -> None:
        """A custom language; its name, suffix and short name must be free, the suffix must begin with _."""
        name = name.strip()
        taken = {*(k.lower() for k in SUFFIXES), *(k.lower() for k in self.custom_languages)}
        if not name or name.lower() in taken:
            raise ConfigError(f"the language {name!r} exists already or has no name")
        if not suffix.startswith("_") or len(suffix) < 2 or suffix in (*SUFFIXES.values(), *self.custom_languages.values()):
            raise ConfigError(f"the suffix {suffix!r} is taken or does not begin with _")
        if short is not None and (short.lower() in taken or short.lower() in (s.lower() for s in self.custom_language_shorts)):
            raise ConfigError(f"the short name {short!r} is taken")
        self.custom_languages[name] = suffix
        if short is not None:
            self.custom_language_shorts[short] = name

    def remove_language(self, name: str) -> None:
        if name not in self.custom_languages:
            raise ConfigError(f"no custom language {name!r}")
        if any(d.language == name for d in [*self.lang_dirs, *([self.src_dir] if self.src_dir else [])]):
            raise ConfigError(f"{name!r} is in use")
        del self.custom_languages[name]
        self.custom_language_shorts = {s: n for s, n in self.custom_language_shorts.items() if n != name}

    # -- directories and files

    def set_source(self, path: str, language: str) -> None:
        path = normal(path)
        if any(normal(d.path) == path for d in self.lang_dirs):
            raise ConfigError(f"{path} is a target directory")
        self.src_dir = LangDir(self.language(language), path)

    def add_target(self, language: str, path: str | None = None) -> LangDir:
        language = self.language(language)
        path = normal(path or self.name + self.suffix(language))
        if any(d.language.lower() == language.lower() for d in self.lang_dirs):
            raise ConfigError(f"there is a target directory for {language}")
        if self.src_dir and normal(self.src_dir.path) == path:
            raise ConfigError(f"{path} is the source directory")
        self.lang_dirs.append(LangDir(language, path))
        return self.lang_dirs[-1]

    def remove_target(self, language: str) -> LangDir:
        found = self.target(language)
        self.lang_dirs.remove(found)
        return found

    def target(self, language: str) -> LangDir:
        for d in self.lang_dirs:
            if d.language.lower() == self.language(language).lower():
                return d
        raise ConfigError(f"no target directory for {language}")

    def add_file(self, path: str) -> None:
        path = normal(path)
        if self.src_dir is None or not (path + "/").startswith(normal(self.src_dir.path) + "/"):
            raise ConfigError(f"{path} is not in the source directory")
        if path not in self.translatable_files:
            self.translatable_files.append(path)

    def remove_file(self, path: str) -> None:
        if normal(path) not in self.translatable_files:
            raise ConfigError(f"{path} is not listed")
        self.translatable_files.remove(normal(path))

    def expand(self, paths: list[str]) -> list[str]:
        """Files as they are, directories as the translatable files under them, in the configured order."""
        out: list[str] = []
        for path in map(normal, paths):
            below = [f for f in self.translatable_files if f == path or f.startswith(path + "/")]
            if not below:
                raise ConfigError(f"nothing to translate in {path}")
            out += [f for f in below if f not in out]
        return out

    # -- models

    def routed(self, use_reasoning: bool = False) -> tuple[tuple[str, str], tuple[str, str] | None]:
        """Main and reasoning (service, model). With the flag the reasoning model takes the main place, alone."""
        main = (self.llm_service, self.llm_model)
        reasoning = (self.reasoning_service, self.reasoning_model) if self.reasoning_service and self.reasoning_model else None
        return (reasoning or main, None) if use_reasoning else (main, reasoning)

    # -- parser settings

    def set_command_args(self, command: str, mandatory: list[int], optional: list[int] | None = None) -> None:
        numbers = {"mandatory": tidy_numbers(mandatory), "optional": tidy_numbers(optional or [])}
        self.latex_command_args[command.strip().lstrip("\\")] = numbers

    def add_name(self, setting: str, name: str) -> None:
        names = getattr(self, setting)
        setattr(self, setting, sorted({*names, name.strip().lstrip("\\")}))

    def remove_name(self, setting: str, name: str) -> None:
        names = getattr(self, setting)
        if name.strip() not in names:
            raise ConfigError(f"{name} is not in {setting}")
        setattr(self, setting, [n for n in names if n != name.strip()])

    def set_typst_args(self, function: str, names: list[str]) -> None:
        self.typst[function.strip()] = sorted({n.strip().lower() for n in names if n.strip()})


def normal(path: str) -> str:
    return os.path.normpath(path).replace(os.sep, "/")


def tidy_numbers(numbers: list[int]) -> list[int]:
    """Distinct numbers in order; they count from 1."""
    if any(n < 1 for n in numbers):
        raise ConfigError("argument numbers count from 1")
    return sorted(set(numbers))


def from_dict(values: dict) -> ProjectConfig:
    """A configuration from its plain form; unknown keys are ignored."""
    known = {f.name for f in fields(ProjectConfig)}
    values = {k: v for k, v in values.items() if k in known}
    values["lang_dirs"] = [LangDir(**d) for d in values.get("lang_dirs", [])]
    if values.get("src_dir"):
        values["src_dir"] = LangDir(**values["src_dir"])
    return ProjectConfig(**values)


def load(path: str) -> ProjectConfig:
    with open(path, "rb") as file:
        found = from_dict(tomllib.load(file))
    if found.xml_retries_before_reasoning < 0:
        raise ConfigError("the number of retries must not be negative")
    return found


def save(config: ProjectConfig, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(to_toml({k: v for k, v in asdict(config).items() if v is not None}))


def to_toml(values: dict, prefix: str = "") -> str:
    """TOML of strings, numbers, lists and nested tables."""
    plain = lambda v: json.dumps(v, ensure_ascii=False)
    rows, tables = [], []
    for key, value in values.items():
        name = key if key.replace("_", "").replace("-", "").isalnum() and key.isascii() else plain(key)
        if isinstance(value, dict):
            tables.append(f"\n[{prefix}{name}]\n{to_toml(value, f'{prefix}{name}.')}")
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            tables += [f"\n[[{prefix}{name}]]\n{to_toml(item, f'{prefix}{name}.')}" for item in value]
        else:
            rows.append(f"{name} = {str(value).lower() if isinstance(value, bool) else plain(value)}\n")
    return "".join(rows) + "".join(tables)


def migrate_json(json_path: str, toml_path: str) -> bool:
    """Turns a JSON configuration into TOML; False if there is none, an error if the TOML exists."""
    if not os.path.exists(json_path):
        return False
    if os.path.exists(toml_path):
        raise ConfigError(f"{toml_path} exists")
    with open(json_path, encoding="utf-8") as file:
        save(from_dict(json.load(file)), toml_path)
    os.remove(json_path)
    return True


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines are skipped, one pair of matching quotes is taken off, the last wins."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (part.strip() for part in line.split("=", 1))
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        if key:
            out[key] = value
    return out


def resolve_keys(shell: dict[str, str], file: dict[str, str], main: str = "LLM_API_KEY", reasoning: str = "LLM_REASONING_API_KEY") -> tuple[str | None, str | None]:
    """Main and reasoning key: the shell goes before the file, the reasoning key falls back to the main one."""
    first = shell.get(main) or file.get(main)
    return first, shell.get(reasoning) or file.get(reasoning) or first
