"""Voxel profiles: the attributes of a voxel, their Spark types and their bytes in a tile file."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class VoxelProfile:
    """Fields as (name, numpy type of the file, Spark type). Numbers in files are big-endian."""

    name: str
    fields: tuple[tuple[str, str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, t) for n, t, _ in self.fields])

    @property
    def voxel_bytes(self) -> int:
        return self.dtype.itemsize

    @property
    def attributes(self) -> list[str]:
        return [n for n, _, _ in self.fields]

    def ddl(self) -> str:
        return ", ".join(f"{n} {s}" for n, _, s in self.fields)


_REGISTRY: dict[str, VoxelProfile] = {}


def register(profile: VoxelProfile) -> VoxelProfile:
    """Makes a profile known by name; a second one of the same name replaces it."""
    _REGISTRY[profile.name] = profile
    return profile


def profile(name: str) -> VoxelProfile:
    if name not in _REGISTRY:
        raise ValueError(f"no voxel profile named {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


SIMPLE = register(VoxelProfile("simple", (("attr1", ">i1", "smallint"),)))
NORMAL = register(VoxelProfile("normal", tuple((f"attr{k}", ">i1", "smallint") for k in range(1, 11))))
GEOLOGY = register(
    VoxelProfile(
        "geology",
        (("stratum", ">i1", "smallint"), ("lithology", ">i1", "smallint"), ("moisture", ">f4", "float"), ("hazard", ">f4", "float"), ("uncertainty", ">f4", "float")),
    )
)
PIXEL2D = register(VoxelProfile("pixel2d", (("value", ">i4", "int"),)))
#: The profile of readers that are not told one.
DEFAULT = NORMAL
