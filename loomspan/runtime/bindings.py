"""The inputs a step was bound to, frozen as a contract with an identity."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from loomspan.functions.hashing import canonical_json, clean, sha256

ADMISSION = ("expected", "expected_source", "observed")


@dataclass(frozen=True)
class Bound:
    """One input: the artifact's id, its content identity (``kind:value``) and where it came from."""

    artifact_id: str
    identity: str
    source: str | None = None


@dataclass(frozen=True)
class Binding:
    step: str
    contract: str
    inputs: Mapping[str, Bound]
    metadata: Mapping[str, Any] = field(default_factory=dict)
    admission: Mapping[str, Mapping[str, str | None]] = field(default_factory=dict)
    diagnostics: Mapping[str, Any] = field(default_factory=dict)

    def identity(self) -> dict[str, Any]:
        """What makes two bindings the same: step, contract, the inputs' contents and metadata; not where they lie."""
        return {"version": 1, "step": self.step, "contract": self.contract, "inputs": {k: b.identity for k, b in sorted(self.inputs.items())}, "metadata": clean(self.metadata)}

    def digest(self) -> str:
        return sha256(canonical_json(self.identity()))

    def evidence(self) -> str:
        """All that is known of the binding, as JSON."""
        rows = {k: {"artifact_id": b.artifact_id, "identity": b.identity, "source": b.source} for k, b in self.inputs.items()}
        return canonical_json({"identity": self.identity(), "inputs": rows, "admission": {k: dict(v) for k, v in self.admission.items()}, "diagnostics": clean(self.diagnostics)})

    def row(self, run_id: str, invocation_id: str, at: Any) -> dict[str, Any]:
        """The row of the catalog's table of binding invocations."""
        return {"id": invocation_id, "run_id": run_id, "binding_hash": self.digest(), "evidence": self.evidence(), "created_at": at}


class BindingBuilder:
    """Collects a binding; :meth:`freeze` checks it and makes it unchangeable."""

    def __init__(self, step: str, contract: str):
        self._step, self._contract = step, contract
        self._inputs: dict[str, Bound] = {}
        self._metadata: dict[str, Any] = {}
        self._admission: dict[str, dict[str, str | None]] = {}
        self._diagnostics: dict[str, Any] = {}

    def bind(self, parameter: str, artifact: Mapping[str, Any], source: str | None = None) -> BindingBuilder:
        """Bind a parameter to an artifact of the catalog; it must have a content id or hash."""
        if parameter in self._inputs:
            raise ValueError(f"{parameter} is bound already")
        identity = f"content:{artifact['content_id']}" if artifact.get("content_id") else f"hash:{artifact['hash']}" if artifact.get("hash") else None
        if identity is None:
            raise ValueError(f"{parameter}: artifact {artifact.get('id')} has no content identity")
        self._inputs[parameter] = Bound(artifact["id"], identity, source or artifact.get("container_uri"))
        return self

    def with_metadata(self, **values: Any) -> BindingBuilder:
        self._metadata |= values
        return self

    def with_diagnostics(self, **values: Any) -> BindingBuilder:
        self._diagnostics |= values
        return self

    def admit(self, parameter: str, observed: str, expected: str | None = None, expected_source: str | None = None) -> BindingBuilder:
        """Note the identity that was seen when an input was taken in, and the one that was expected."""
        self._admission[parameter] = dict(zip(ADMISSION, (expected, expected_source, observed)))
        return self

    def freeze(self) -> Binding:
        for parameter, seen in self._admission.items():
            if parameter not in self._inputs:
                raise ValueError(f"{parameter} was admitted but is not bound")
            if seen["observed"] != self._inputs[parameter].identity:
                raise ValueError(f"{parameter}: {seen['observed']} was seen, but {self._inputs[parameter].identity} is bound")
            if (seen["expected"] is None) != (seen["expected_source"] is None):
                raise ValueError(f"{parameter}: an expected identity and its source go together")
        frozen = (MappingProxyType(dict(m)) for m in (self._inputs, self._metadata, self._admission, self._diagnostics))
        return Binding(self._step, self._contract, *frozen)
