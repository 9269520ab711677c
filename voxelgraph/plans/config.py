"""Run settings: defaults, overrides where given, attributes that are attached later and kept."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class RunConfig:
    voxel_size: float = 1.0
    periodic_x: bool = False
    nu: float = 1.0
    dt: float = 0.1
    n_steps: int = 900
    body_force: tuple[float, float, float] = (1.0, 0.0, 0.0)
    wall_distance_floor: float = 0.25
    transmissibility_floor: float = 1e-12
    pressure_gauge_eps: float = 1e-12
    linear_solver_mode: str = "cg"
    attached: dict = field(default_factory=dict)

    def overridden(self, **given) -> RunConfig:
        """Values that aren't None; body_force_x sets the first part of the force; unknown names are attached."""
        own = {k: v for k, v in given.items() if v is not None}
        if "body_force_x" in own:
            own["body_force"] = (float(own.pop("body_force_x")), *self.body_force[1:])
        known = {f.name for f in fields(self)} - {"attached"}
        attached = self.attached | {k: v for k, v in own.items() if k not in known}
        return replace(self, **{k: v for k, v in own.items() if k in known}, attached=attached)

    def rows(self) -> list[tuple[str, str]]:
        return sorted([(f.name, str(getattr(self, f.name))) for f in fields(self) if f.name != "attached"] + [(k, str(v)) for k, v in self.attached.items()])


def coarse(base: RunConfig, stride: tuple[int, int, int], **given) -> RunConfig:
    """A coarse run's settings from a reference run's: everything attached to it is kept."""
    return base.overridden(stride_zyx=stride, **given)


def value_list(*sources: list | str | None) -> list[str]:
    """The first source that has any value: a list or a comma text."""
    for s in sources:
        own = [v.strip() for v in s.split(",")] if isinstance(s, str) else [str(v) for v in s or []]
        own = [v for v in own if v]
        if own:
            return own
    return []
