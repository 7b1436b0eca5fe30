"""Options, from defaults, a YAML-like mapping, the environment and arguments."""

from __future__ import annotations

import dataclasses
import importlib
import os
from dataclasses import dataclass

PREFIX = "ARBORA_"
YES_NO = ("yes", "no")


@dataclass(frozen=True)
class Options:
    model: str = "rules"  # or package.module:function, or a model of the service at model_url
    model_url: str | None = None
    model_concurrency: int = 5
    model_timeout: float = 300.0
    model_tasks: int | None = None  # that ask at a time; as many as the session runs by default
    model_replies: str | None = None  # a folder that keeps replies for later runs
    token_counter: str | None = None  # package.module:function from texts to numbers of tokens; an estimate without one
    toc_check_page_num: int = 20
    max_page_num_each_node: int = 10
    max_token_num_each_node: int = 20_000
    if_add_node_id: str = "yes"
    if_add_node_summary: str = "yes"
    if_add_doc_description: str = "yes"
    if_add_node_text: str = "no"
    converter_url: str | None = None
    converter_timeout: float = 300.0
    if_thinning: str = "no"
    min_token_threshold: int = 5_000
    summary_token_threshold: int = 200

    def __post_init__(self):
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if f.name.startswith("if_") and value not in YES_NO:
                raise ValueError(f"{f.name} is yes or no, not {value!r}")
            if (f.type == "int" or f.type == "int | None" and value is not None) and (isinstance(value, bool) or not isinstance(value, int)):
                raise ValueError(f"{f.name} is a whole number, not {value!r}")


def _typed(kind: str | None, raw: str):
    return int(raw) if kind in ("int", "int | None") else float(raw) if kind == "float" else raw


def _value(text: str) -> str:
    """What stands after a colon: in quotes as it is, else up to a comment, which begins a line or follows a space."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        quote, out, k = text[0], [], 1
        while k < len(text):
            if text[k] == quote:
                if quote == "'" and text[k + 1 : k + 2] == quote:  # a quote in quotes is doubled
                    k += 1
                elif text[k + 1 :].strip() and not text[k + 1 :].lstrip().startswith("#"):
                    raise ValueError(f"more after the quotes: {text}")
                else:
                    return "".join(out)
            elif quote == '"' and text[k] == "\\" and k + 1 < len(text):
                k += 1
                out.append({"n": "\n", "t": "\t"}.get(text[k], text[k]))
                k += 1
                continue
            out.append(text[k])
            k += 1
        raise ValueError(f"quotes that don't end: {text}")
    for k, c in enumerate(text):
        if c == "#" and (k == 0 or text[k - 1] in " \t"):
            return text[:k].rstrip()
    return text


def read_file(path: str) -> dict:
    """Options of a file of ``name: value`` lines, the part of YAML that they need; an empty or missing file has none.

    Options have no parts, so a value that goes on in deeper lines, a list or a mapping is an error rather than half a value.
    """
    if not os.path.exists(path):
        return {}
    kinds, found = {f.name: f.type for f in dataclasses.fields(Options)}, {}
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            bare = line.strip()
            if not bare or bare.startswith("#") or bare in ("---", "..."):
                continue
            name, colon, value = line.partition(":")
            if line[0] in " \t" or bare.startswith("- ") or not colon or value[:1] not in ("", " ", "\t", "\n") or value.strip()[:1] in ("[", "{", "|", ">"):
                raise ValueError(f"{path}, line {number}: options are lines of a name, a colon and one value")
            name, raw = name.strip().strip("\"'"), _value(value)
            if raw and (value.strip()[:1] in ("'", '"') or raw not in ("null", "~", "Null", "NULL")):
                found[name] = _typed(kinds.get(name), raw)
    return found


def load(given: Options | dict | None = None, environment: dict[str, str] | None = None, path: str | None = None) -> Options:
    """Options of ``given`` over those of the environment, over those of a file, over the defaults; of a mapping nulls are left
    out.  The file is ``path``, or what ARBORA_CONFIG names."""
    if isinstance(given, Options):
        return given
    if given is not None and not isinstance(given, dict):
        raise TypeError("options are a mapping, Options or None")
    environment = dict(os.environ) if environment is None else environment
    kinds = {f.name: f.type for f in dataclasses.fields(Options)}
    path = path or environment.get(PREFIX + "CONFIG")
    if path and not os.path.exists(path):
        raise ValueError(f"no such options file: {path}")
    values = read_file(path) if path else {}
    for name, kind in kinds.items():
        if (raw := environment.get(PREFIX + name.upper())) is not None:
            values[name] = _typed(kind, raw)
    values |= {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := values.keys() - kinds.keys():
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    return Options(**values)


def reasoner(options: Options):
    """The reasoner that the options name."""
    from .reasoner import load as load_reasoner

    return load_reasoner(options.model, {"url": options.model_url, "concurrency": options.model_concurrency, "timeout": options.model_timeout}, options.model_tasks, options.model_replies)


def token_counter(options: Options):
    """The function that counts tokens, if the options name one."""
    if options.token_counter is None:
        return None
    module, _, function = options.token_counter.partition(":")
    return getattr(importlib.import_module(module), function)


def converter(options: Options):
    """The converter that the options name if it is up, else one in the same process if that is installed, else none."""
    from .sources.convert import HttpConverter, LocalConverter, local_converter_there

    service = HttpConverter(options.converter_url, options.converter_timeout) if options.converter_url else None
    if service is not None and service.healthy():
        return service
    return LocalConverter() if local_converter_there() else None
