"""Settings: YAML files merged left to right, key=value overrides, validation against closed dataclasses."""

from __future__ import annotations

import dataclasses
import os
import types
import typing
from collections.abc import Sequence

import yaml

#: Units of bytes by powers of 1024.
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones, sections within sections; lists and values are replaced whole."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overridden(settings: dict, overrides: Sequence[str]) -> dict:
    """settings with a.b=value overrides, whose values are YAML."""
    for item in overrides:
        name, sign, value = item.partition("=")
        if not sign or not name:
            raise ValueError(f"not an override: {item}")
        nested: object = yaml.safe_load(value) if value else None
        for part in reversed(name.split(".")):
            nested = {part: nested}
        settings = merged(settings, nested)
    return settings


def load(paths: Sequence[str], overrides: Sequence[str] = ()) -> dict:
    if not paths:
        raise ValueError("settings need a file")
    layers = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            layers.append(yaml.safe_load(f) or {})
    return overridden(merged(*layers), overrides)


def from_arguments(arguments: Sequence[str]) -> dict:
    """Files, then key=value overrides, as on a command line."""
    return load([a for a in arguments if "=" not in a], [a for a in arguments if "=" in a])


def parse(settings: dict, kind: type, where: str = "") -> object:
    """A dataclass from settings: unknown names, missing ones and values of other types are errors, in all sections."""
    if not isinstance(settings, dict):
        raise TypeError(f"{where or 'settings'} has to be a section")
    hints = typing.get_type_hints(kind)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(settings) - set(fields)):
        raise ValueError(f"unknown settings: {', '.join(where + n for n in unknown)}")
    values = {}
    for name, field in fields.items():
        if name in settings:
            values[name] = _value(settings[name], hints[name], where + name)
        elif field.default is dataclasses.MISSING and field.default_factory is dataclasses.MISSING:
            raise ValueError(f"missing setting: {where + name}")
    return kind(**values)


def _value(value: object, hint: object, where: str) -> object:
    origin, inner = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in inner:
            return None
        return _value(value, next(t for t in inner if t is not type(None)), where)
    if dataclasses.is_dataclass(hint):
        return parse(value, hint, where + ".")
    if origin is list:
        if not isinstance(value, list):
            raise TypeError(f"{where} has to be a list")
        return [_value(v, inner[0], f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise TypeError(f"{where} has to be a section")
        return {k: _value(v, inner[1], f"{where}.{k}") for k, v in value.items()}
    if hint is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(hint, type) and (not isinstance(value, hint) or (isinstance(value, bool) and hint is not bool)):
        raise TypeError(f"{where} has to be {hint.__name__}, not {value!r}")
    return value


def composed(base: dict, model: dict, dataset: dict, task: dict, retired: Sequence[str] = ()) -> dict:
    """An evaluation's settings from its parts; a name that is no longer in use is an error, as is a task that the dataset is not for."""
    out = merged(base, {"model": model}, {"dataset": dataset}, {"task": task})
    for name in retired:
        section: object = out
        for part in name.split("."):
            section = section.get(part, _NONE) if isinstance(section, dict) else _NONE
        if section is not _NONE:
            raise ValueError(f"no longer in use: {name}")
    if "tasks" in dataset and task.get("name") not in dataset["tasks"]:
        raise ValueError(f"the dataset is not for the task {task.get('name')}")
    return out


_NONE = object()


def path(override: str | None, default: str | None, required: bool = False) -> str | None:
    """The override, else the default; required, one that is there."""
    out = override or default
    if required and (out is None or ("://" not in out and not os.path.exists(out))):
        raise FileNotFoundError(out or "no path")
    return out


def single(files: Sequence[str], what: str) -> str:
    if len(files) != 1:
        raise ValueError(f"one {what} expected, not {len(files)}")
    return files[0]


def human_bytes(n: int | float) -> str:
    """Bytes in the largest unit that leaves at least one of it, two digits after the point; a fraction of a byte is an error."""
    if isinstance(n, bool) or n != int(n):
        raise TypeError(f"not a number of bytes: {n!r}")
    power = min(len(UNITS), max(0, (int(n).bit_length() - 1) // 10))
    return f"{int(n)} B" if not power else f"{n / 1024**power:.2f} {UNITS[power - 1]}"


def check_names(names: Sequence[str], known: Sequence[str], what: str) -> None:
    """An error where a name is repeated or unknown."""
    if len(set(names)) != len(names):
        raise ValueError(f"repeated {what}")
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no such {what}: {', '.join(unknown)}")


def check_evaluation(settings: dict) -> dict:
    """An evaluation's settings whose parts go together: metrics that the task has, resamples where there are controls to compare, layers that differ, a split that is scored."""
    from ..operators import scoring

    task = settings.get("task", {}).get("name")
    check_names([task], list(scoring.TASKS), "task")
    check_names(settings.get("metrics", []), [*scoring.METRICS, *scoring.WHOLE, "fmax"], "metric")
    check_names(settings.get("controls", []), scoring.CONDITIONS, "condition")
    if settings.get("controls") and settings.get("permutations", 0) and not settings.get("resamples", 0):
        raise ValueError("controls are compared over resamples")
    layers = settings.get("layers", [])
    if len(set(layers)) != len(layers):
        raise ValueError("layers have to differ")
    if settings.get("split", "test") not in ("train", "validation", "test"):
        raise ValueError("no such split")
    return settings
