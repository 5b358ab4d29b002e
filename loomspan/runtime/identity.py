"""Identity of code and files on the driver: git versions, functions, paths, and the depth of what is stored as JSON."""

from __future__ import annotations

import hashlib
import inspect
import subprocess
from collections.abc import Callable, Iterable
from fnmatch import fnmatch
from pathlib import Path
from typing import Any

from loomspan.functions.hashing import sha256


class CodeIdentityError(RuntimeError):
    """The code of a run can't be identified in the way asked for."""


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError) as e:
        raise CodeIdentityError(f"no git repository can be read at {root}: {e}") from e


def git_version(root: str = ".") -> str:
    """The commit, with ``-dirty-<hash>`` if tracked Python files differ from it."""
    commit = _git(root, "rev-parse", "HEAD").strip()
    diff = _git(root, "diff", "HEAD", "--", "*.py")
    return f"{commit}-dirty-{sha256(diff)[:12]}" if diff.strip() else commit


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def callable_hash(fn: Callable, strategy: str = "module", extra: Iterable[str] = (), root: str = ".") -> str:
    """Identity of a function: ``source`` is its own text, ``module`` the file it stands in; wrappers are looked through.

    Further files are mixed in by their contents; one that isn't there counts as MISSING.
    """
    inner = inspect.unwrap(fn)
    try:
        if strategy == "source":
            parts = [f"src:{sha256(inspect.getsource(inner))}"]
        elif strategy == "module":
            parts = [f"mod:{_digest(Path(inspect.getfile(inner)))}"]
        else:
            raise CodeIdentityError(f"unknown strategy: {strategy}")
    except (OSError, TypeError) as e:
        raise CodeIdentityError(f"{fn} can't be inspected: {e}") from e
    parts += [f"dep:{e}:{_digest(Path(root) / e) if (Path(root) / e).exists() else 'MISSING'}" for e in extra]
    return sha256("|".join(sorted(parts)))


def code_version(fn: Callable | None, mode: str = "callable_source", extra: Iterable[str] = (), root: str = ".") -> str:
    """The code part of a run's identity: ``repo_git``, ``callable_module`` or ``callable_source``."""
    if mode == "repo_git":
        return git_version(root)
    if fn is None or mode not in ("callable_module", "callable_source"):
        raise CodeIdentityError(f"code identity {mode} needs a function" if fn is None else f"unknown code identity: {mode}")
    return callable_hash(fn, mode.removeprefix("callable_"), extra, root)


def keep_by(patterns: Iterable[str] | None) -> Callable[[str], bool] | None:
    """A choice of relative paths by patterns, as :func:`loomspan.runtime.tracker.file_hash` takes it; None keeps all."""
    wanted = None if patterns is None else list(patterns)
    return None if wanted is None else lambda rel: any(fnmatch(rel, p) for p in wanted)


def check_depth(value: Any, most: int = 50) -> None:
    """Raise if mappings and lists are nested deeper than ``most``; a scalar has depth 1."""
    level = [value]
    for _ in range(most):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return
    raise ValueError(f"JSON is nested deeper than {most}")
