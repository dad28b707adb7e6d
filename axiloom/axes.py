"""Named, role-tagged dimensions. An axis is a key column of every relation that varies along it."""

from __future__ import annotations

from dataclasses import dataclass

DOMAIN, PARAMETER, ENSEMBLE = "DOMAIN", "PARAMETER", "ENSEMBLE"
AxisRole = str


@dataclass(frozen=True, order=True)
class Axis:
    """Equal by name and role. Roles other than the three built-in ones are inert keys."""

    name: str
    role: AxisRole = DOMAIN

    @property
    def key(self) -> str:
        """The column that holds the position along this axis."""
        return f"{self.role[:1].lower()}_{self.name}"


TIME = Axis("time", DOMAIN)
_LAYOUT = {PARAMETER: 0, ENSEMBLE: 1, DOMAIN: 2}


def layout(axes) -> list[Axis]:
    """Axes in the order in which results are laid out: parameters, ensembles, domain; each as first given."""
    return sorted(dict.fromkeys(axes), key=lambda a: _LAYOUT.get(a.role, 2))
