"""All registered queries but those of the corpus subpackage."""

from __future__ import annotations

from . import assessment, derivation, documents, evidence, scalars, streams, validation
from .base import Query


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (assessment, scalars, evidence, derivation, validation, documents, streams):
        out |= module.queries()
    return out
