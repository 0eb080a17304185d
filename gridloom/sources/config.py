"""Settings of a registration from files of ``key = value`` lines or from arguments."""

from __future__ import annotations

import configparser
import warnings
from dataclasses import dataclass, fields

from .errors import ConfigError

REQUIRED = ("fixed", "moved", "nodespacing")


@dataclass(frozen=True)
class Settings:
    """Known keys and their defaults; names of keys and of switches do not depend on case."""

    fixed: str = ""
    moved: str = ""
    nodespacing: int = 0
    mask: str = ""
    registered: str = "registered.xdmf"
    map: str = "map.xdmf"
    registered_h5_path: str = "/registered"
    map_h5_path: str = "/map"
    with_lambda: str = "auto"
    lambda_mult: float = 1.0
    with_memory: bool = True
    max_iterations: int = 100
    save_intermediate_frames: bool = False
    intermediate_template: str = "%name%-intermediate-%s%-%i%%ext%"
    intermediate_map_template: str = "%name%-intermediate-map-%s%-%i%%ext%"
    intermediate_directory: str = "intermediates"
    verbose: bool = False
    memory_report: bool = True

    @property
    def factor(self) -> float | None:
        """The smoothing factor, or None where it is to be searched for."""
        if self.with_lambda.lower() == "auto":
            return None
        try:
            return float(self.with_lambda)
        except ValueError as e:
            raise ConfigError(f"lambda can't be {self.with_lambda!r}") from e


#: Keys whose names are words of the language here.
NAMES = {"lambda": "with_lambda"}
KINDS = {f.name: f.type for f in fields(Settings)}


def typed(key: str, value: str):
    kind = KINDS[key]
    try:
        if kind == "bool":
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[value.strip().lower()]
        return {"int": int, "float": float, "str": str}[kind](value.strip())
    except (KeyError, ValueError) as e:
        raise ConfigError(f"{key} can't be {value!r}") from e


def validated(found: dict[str, str], strict: bool) -> Settings:
    known = {}
    for raw, value in found.items():
        key = NAMES.get(raw.lower(), raw.lower())
        if key in KINDS:
            known[key] = typed(key, value)
        elif strict:
            raise ConfigError(f"unknown option {raw}")
        else:
            warnings.warn(f"unknown option {raw}", stacklevel=3)
    missing = [k for k in REQUIRED if not known.get(k)]
    if missing:
        raise ConfigError(f"missing: {', '.join(missing)}")
    return Settings(**known)


def from_file(path: str) -> Settings:
    """Lines of ``key = value`` without sections; unknown keys give warnings."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    with open(path, encoding="utf-8") as f:
        parser.read_string(f"[all]\n{f.read()}")
    return validated(dict(parser["all"]), strict=False)


def from_arguments(arguments: list[str]) -> Settings:
    """``register key value ...``; switches stand alone, unknown keys are errors."""
    if not arguments or arguments[0].lower() != "register":
        raise ConfigError("the first argument must be register")
    found, rest = {}, list(arguments[1:])
    while rest:
        key = rest.pop(0).lower()
        if KINDS.get(NAMES.get(key, key)) == "bool":
            found[key] = "true"
        elif rest:
            found[key] = rest.pop(0)
        else:
            raise ConfigError(f"{key} has no value")
    return validated(found, strict=True)
