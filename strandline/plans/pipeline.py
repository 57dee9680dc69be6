"""Feature modalities as plug-ins (Q13, Q14), and profiles of them (Q16): name, columns, what they need, and a DataFrame -> DataFrame function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Modality:
    name: str
    outputs: tuple[str, ...]
    transform: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    after: tuple[str, ...] = field(default=())


class Features:
    """A set of modalities, run in an order that respects their inputs."""

    def __init__(self):
        self.known: dict[str, Modality] = {}

    def register(self, modality: Modality) -> Modality:
        if modality.name in self.known:
            raise ValueError(f"{modality.name} is there already")
        self.known[modality.name] = modality
        return modality

    def order(self, names: list[str]) -> list[Modality]:
        """Q14: inputs (optional ones too) first, names in alphabetical order where free."""
        made = {c: n for n in names for c in self.known[n].outputs}
        waits = {n: {made[c] for c in (*self.known[n].needs, *self.known[n].optional) if c in made} - {n} | (set(self.known[n].after) & set(names)) for n in names}
        out: list[Modality] = []
        while waits:
            free = sorted(n for n, w in waits.items() if not w)
            if not free:
                raise ValueError(f"a circle among {sorted(waits)}")
            out.append(self.known[free[0]])
            waits.pop(free[0])
            waits = {n: w - {free[0]} for n, w in waits.items()}
        return out

    def profile(self, profiles: dict[str, dict], name: str) -> list[str]:
        """Q16: the modalities of a named profile: those of the profile that it `extends`, and its own `modalities`, without those that it `excludes`."""
        said, names = profiles[name], []
        for n in [*(self.profile({k: v for k, v in profiles.items() if k != name}, said["extends"]) if "extends" in said else []), *said.get("modalities", [])]:
            if n not in self.known:
                raise ValueError(f"profile {name} names {n}, which isn't registered")
            if n not in names and n not in said.get("excludes", []):
                names.append(n)
        return names

    def run(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Each modality in turn; inputs are checked before it and outputs after it."""
        for m in self.order(names):
            if lacking := [c for c in m.needs if c not in df.columns]:
                raise ValueError(f"{m.name} needs {lacking}")
            df = m.transform(df)
            if lacking := [c for c in m.outputs if c not in df.columns]:
                raise ValueError(f"{m.name} didn't make {lacking}")
        return df
