"""Run configuration: ``key = value`` files with ``#`` comments."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from lattica.functions.formula import names

log = logging.getLogger("lattica")


@dataclass
class RunConfig:
    data: str = "data.bin"
    formula: str | None = None
    fe_tol: float = 1e-6
    fe_max_iters: int = 500
    fe_names: tuple[str, ...] = ()
    cluster_fe: tuple[int, ...] = ()
    iv_cols: tuple[int, ...] = ()
    iv_z_cols: tuple[int, ...] = ()
    save_fe: str | None = None
    verbose: bool = False


def strip_comment(line: str) -> str:
    """Cut at a ``#`` that begins the line or follows a blank, unless it is quoted."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (not line[:i].strip() or line[i - 1] in " \t"):
            return line[:i]
    return line


def strip_quotes(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def truth(text: str) -> bool:
    return text.strip().lower() in ("1", "true", ".true.")


def load_config(path: str, config: RunConfig | None = None) -> RunConfig:
    """Read a file on top of ``config``.  Lines without ``=`` are left out; unknown keys with a warning."""
    config = config or RunConfig()
    with open(path) as lines:
        for line in lines:
            key, equals, value = strip_comment(line.rstrip("\n")).partition("=")
            key, value = key.strip().lower(), strip_quotes(value.strip())
            if not equals:
                continue
            if key in ("data", "formula"):
                setattr(config, key, value)
            elif key == "fe_tol":
                config.fe_tol = float(value.lower().replace("d", "e"))
            elif key == "fe_max_iters":
                config.fe_max_iters = int(value)
            elif key == "verbose":
                config.verbose = truth(value)
            elif key == "fe_names":
                config.fe_names = names(value)
            elif key in ("cpu_threads", "force_cpu", "use_gpu", "fast"):
                if key == "cpu_threads" and int(value) < 0:
                    raise ValueError("cpu_threads must not be negative")
                log.info("%s has no effect on Spark", key)
            else:
                log.warning("unknown key %r in %s", key, path)
    return config
