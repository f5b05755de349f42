"""Settings of tracing, as named presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class TraceConfig:
    """What steers tracing; lengths are in millimetres."""

    volume_size_ratio: float = 5.0
    magnify_radius: float = 1.0
    add_radius: float = 0.0
    min_radius: float = 0.3
    stop_radius: float = 0.46
    min_resolution: int = 6
    chances: int = 2
    max_foreground: float = 0.3
    prevent_retrace: bool = True
    retrace_steps: int = 5
    assembly_every: int = 20
    assembly_buffer: int = 20
    restart_branch: bool = True
    segmentation: bool = False
    max_steps: int = 500
    max_branches: int = 50
    max_branch_steps: int = 1000
    step_factor: float = 1.0
    turn_degrees: float = 135.0

    def as_dict(self) -> dict:
        return asdict(self)


# Where a preset differs from the default.
PRESETS: dict[str, dict] = {
    "global": {},
    "aorta_tutorial": {"volume_size_ratio": 4.9, "magnify_radius": 1.05, "add_radius": 0.3, "chances": 3, "assembly_every": 10, "assembly_buffer": 10},
    "global_aorta": {"volume_size_ratio": 4.9, "magnify_radius": 1.05, "add_radius": 0.2, "min_resolution": 5, "chances": 3, "retrace_steps": 10},
    "global_coro": {"volume_size_ratio": 5.5, "add_radius": 0.3, "max_foreground": 0.33, "min_resolution": 5, "chances": 3, "retrace_steps": 10, "prevent_retrace": False, "stop_radius": 0.4, "max_branch_steps": 100},
    "global_cereb": {"volume_size_ratio": 5.5, "add_radius": 0.3, "max_foreground": 0.33, "min_resolution": 5, "chances": 3, "retrace_steps": 10, "stop_radius": 0.4, "max_branch_steps": 100},
    "global_pulm": {"add_radius": 0.5, "max_foreground": 0.35, "min_radius": 0.4, "min_resolution": 5, "stop_radius": 0.48, "max_branch_steps": 100, "restart_branch": False},
    "global_default": {"min_radius": 0.4, "stop_radius": 0.48, "max_branch_steps": 100, "restart_branch": False},
    "global_seg": {"segmentation": True, "volume_size_ratio": 4.5, "max_foreground": 0.5},
    "global_test": {"segmentation": True, "volume_size_ratio": 4.0, "max_foreground": 0.5},
    "global_debug": {"volume_size_ratio": 6.0, "max_foreground": 0.5},
}


def preset(name: str = "global", **changes) -> TraceConfig:
    """A preset with changes; unknown names raise."""
    if name not in PRESETS:
        raise FileNotFoundError(f"no preset is named {name!r}")
    return replace(TraceConfig(), **{**PRESETS[name], **changes})
