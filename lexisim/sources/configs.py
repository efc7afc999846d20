"""Scorer configurations as TOML files."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from lexisim.errors import InvalidExtension, LexisimError, TomlError
from lexisim.functions.aline import AlineTables
from lexisim.functions.scorers import SCORERS, Aline, Scorer



def load(kind: str | type[Scorer], path: str, validate: bool = True) -> Scorer:
    """The scorer that a ``.toml`` file describes.

    Alignment tables are not validated, whatever ``validate`` says: common ones do not sum to 1.
    """
    made = SCORERS[kind] if isinstance(kind, str) else kind
    if Path(path).suffix != ".toml":
        raise InvalidExtension(f"{path} is not a .toml file")
    try:
        said = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as why:
        raise TomlError(f"{path}: {why}") from why
    if made is Aline:
        return Aline(AlineTables(**said))
    try:
        return made(**said)
    except LexisimError:
        if validate:
            raise
        out = object.__new__(made)
        vars(out).update({**{k: v.default for k, v in made.__dataclass_fields__.items()}, **said})
        return out


def save(scorer: Scorer, path: str, append_extension: bool = False) -> str:
    """Writes the configuration; gives the path, with ``.toml`` appended if it lacks it and that is allowed."""
    if Path(path).suffix != ".toml":
        if not append_extension:
            raise InvalidExtension(f"{path} is not a .toml file")
        path += ".toml"
    Path(path).write_text(dumps(scorer.to_dict()), encoding="utf-8")
    return path


def dumps(table: dict) -> str:
    """``table`` as TOML: scalars and lists first, then nested tables."""
    lines: list[str] = []
    _write(table, [], lines)
    return "\n".join(lines).strip() + "\n"


def _key(k: str) -> str:
    return k if k and all(c.isascii() and (c.isalnum() or c in "_-") for c in k) else json.dumps(k, ensure_ascii=False)


def _scalar(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_scalar, v)) + "]"
    raise TomlError(f"no TOML value: {v!r}")


def _write(table: dict, at: list[str], lines: list[str]) -> None:
    plain = {k: v for k, v in table.items() if not isinstance(v, dict)}
    if at and (plain or not table):
        lines += ["", f"[{'.'.join(map(_key, at))}]"]
    lines += [f"{_key(k)} = {_scalar(v)}" for k, v in plain.items()]
    for k, v in table.items():
        if isinstance(v, dict):
            _write(v, [*at, k], lines)


