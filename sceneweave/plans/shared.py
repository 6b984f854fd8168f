"""Where jobs keep tables for a while."""

from __future__ import annotations

from sceneweave.operators.cluster import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder"]
